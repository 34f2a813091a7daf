"""SQL forms of the queries that have one."""

from __future__ import annotations

from surety.llm import clustering, embedding_dedup, language, manifest, suffix_dedup, url_filters


def url_rules_and_trust() -> str:
    """Rules by longest match; the rounds of propagation are written out one after another."""
    rules = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for r, v in url_filters.RULES)
    upper, lower = url_filters._UPPER, url_filters._LOWER
    d = url_filters.DAMPING
    rounds, last = [], "state0"
    for k in range(1, url_filters.ROUNDS + 1):
        rounds.append(f"""moved{k} AS (SELECT s.back, e.dst AS host, sum(s.mass * e.w) AS m, sum(s.walk * e.w) AS v
          FROM {last} s JOIN steps e ON e.back = s.back AND e.src = s.host GROUP BY ALL),
        state{k} AS (SELECT a.back, a.host, (1 - {d}::DOUBLE) * a.seed + {d}::DOUBLE * coalesce(m, 0) AS mass,
          (1 - {d}::DOUBLE) * a.even + {d}::DOUBLE * coalesce(v, 0) AS walk
          FROM starts a LEFT JOIN moved{k} q ON q.back = a.back AND q.host = a.host)""")
        last = f"state{k}"
    return f"""
    WITH rules(host, prefix, rule, verdict) AS (VALUES {rules}),
    p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    paths AS (SELECT host, path, count(*) AS n FROM p GROUP BY ALL),
    ruled AS (SELECT q.host, q.path, any_value(q.n) AS n, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
      FROM paths q LEFT JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.prefix) GROUP BY q.host, q.path),
    seeds AS (SELECT host, sum(n) FILTER (verdict = 'allow') AS good, sum(n) FILTER (verdict = 'block') AS bad FROM ruled GROUP BY host),
    links AS (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS href FROM p),
    named AS (SELECT host AS src, CASE WHEN t = '' THEN host ELSE t END AS dst FROM (SELECT host,
      translate(regexp_extract(href, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '{upper}', '{lower}') AS t FROM links) q),
    linked AS (SELECT src, dst, count(*) AS n FROM named GROUP BY ALL),
    hosts AS (SELECT DISTINCT host FROM p),
    labels_of AS (SELECT string_split(host, '.') AS l FROM hosts),
    chain AS (SELECT DISTINCT src FROM (SELECT array_to_string(l[unnest(range(1, len(l) + 1)):], '.') AS src FROM labels_of) q WHERE src LIKE '%.%'),
    up AS (SELECT src, regexp_replace(src, '^[^.]*\\.', '') AS dst, 1 AS n FROM chain),
    up2 AS (SELECT * FROM up WHERE dst LIKE '%.%'),
    stay AS (SELECT DISTINCT src FROM (SELECT src FROM chain UNION ALL SELECT host FROM hosts UNION ALL SELECT dst FROM linked) q),
    edges AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM linked UNION ALL SELECT * FROM up2 UNION ALL SELECT dst, src, n FROM up2
      UNION ALL SELECT src, src, 1 FROM stay) q GROUP BY ALL),
    both_ways AS (SELECT 0 AS back, src, dst, n FROM edges UNION ALL SELECT 1, dst, src, n FROM edges),
    steps AS (SELECT back, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY back, src) AS w FROM both_ways),
    all_hosts AS (SELECT DISTINCT src AS host FROM both_ways),
    weights AS (SELECT h.host, coalesce(good, 0)::DOUBLE AS good, coalesce(bad, 0)::DOUBLE AS bad FROM all_hosts h LEFT JOIN seeds s ON s.host = h.host),
    sums AS (SELECT CASE WHEN sum(good) = 0 THEN 1 ELSE sum(good) END AS g, CASE WHEN sum(bad) = 0 THEN 1 ELSE sum(bad) END AS b, count(*) AS n FROM weights),
    starts AS (SELECT 0 AS back, host, good / g AS seed, 1.0::DOUBLE / n AS even FROM weights, sums
      UNION ALL SELECT 1, host, bad / b, 1.0::DOUBLE / n FROM weights, sums),
    state0 AS (SELECT back, host, seed AS mass, even AS walk FROM starts),
    {', '.join(rounds)},
    judged AS (SELECT host, max(round(mass / walk, {url_filters.DECIMALS})) FILTER (back = 0) AS trust,
      max(round(mass / walk, {url_filters.DECIMALS})) FILTER (back = 1) AS distrust FROM {last} GROUP BY host)
    SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict,
      CASE WHEN j.distrust >= {url_filters.THRESHOLD}::DOUBLE AND j.distrust > j.trust THEN 'block' ELSE 'allow' END) AS verdict
    FROM p JOIN ruled r ON r.host = p.host AND r.path = p.path JOIN judged j ON j.host = p.host"""


def repeated_bytes() -> str:
    """All windows of every text, written as hexadecimal digits."""
    n = suffix_dedup.LENGTH
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT rid, i, md5(substr(h, 2 * i + 1, {2 * n})) AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - {n - 1})) AS i FROM d) q),
    hit AS (SELECT rid, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
    opened AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {n} THEN 0 ELSE 1 END AS o FROM hit),
    runs AS (SELECT rid, i, sum(o) OVER (PARTITION BY rid ORDER BY i) AS r FROM opened),
    spans AS (SELECT rid, min(i) AS a, max(i) + {n} AS b FROM runs GROUP BY rid, r),
    before AS (SELECT s.rid, a, b, coalesce(lag(b) OVER (PARTITION BY s.rid ORDER BY a), 0) AS z FROM spans s),
    kept AS (SELECT q.rid, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS n
      FROM before q JOIN d ON d.rid = q.rid GROUP BY q.rid)
    SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
      sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
    FROM d LEFT JOIN kept k ON k.rid = d.rid"""


def linked_vectors() -> str:
    """All pairs of one label, and reachability over the links."""
    return f"""
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_dot_product(e, e) > 0),
    links AS (SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {embedding_dedup.COSINE}::DOUBLE),
    reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    low AS (SELECT a AS rid, min(vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY a),
    n AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a)
    SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
    FROM v JOIN low ON low.rid = v.rid LEFT JOIN n ON n.rid = v.rid"""



def crc32(value: str) -> str:
    """crc32 of an integer written in decimal, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_transform(string_split(({value})::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
      lambda crc, d: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, d)), 4294967295))"""


def merkle_proofs() -> str:
    """All levels by recursion; every leaf meets its run at each of them."""
    k = manifest.FAN_OUT
    upper, lower = url_filters._UPPER, url_filters._LOWER

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, tree: str, bottom: str) -> str:
        return f"""{name} AS (SELECT {tree} AS tree, 0 AS lvl, i, h, n FROM {bottom}
          UNION ALL SELECT tree, lvl + 1, i // {k}, sha256(string_agg(h, '' ORDER BY i)), (max(n) + {k - 1}) // {k} FROM {name} WHERE n > 1 GROUP BY tree, lvl, i // {k}),
        {name}_runs AS (SELECT tree, lvl, i // {k} AS r, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""

    def beside(runs: str, i: str) -> str:
        at = f"({i} // ({k} ** {runs}.lvl)::BIGINT)"
        return f"array_to_string(hs[1:{at} % {k}], '') || '@' || array_to_string(hs[{at} % {k} + 2:], '')"

    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, {leaf("text")} AS h,
      CASE WHEN coalesce({crc32("doc_id")} % {manifest.TAMPERED} = 0, false) THEN {leaf(f"translate(text, '{upper}', '{lower}')")} END AS other FROM documents),
    leaves AS (SELECT *, coalesce('=' || source, '-') AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
      count(*) OVER (PARTITION BY source) AS n FROM d),
    {levels("low", "name", "leaves")},
    subroots AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree <> '-', tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
    {levels("high", "0", "subroots")},
    steps AS (SELECT rid, low_runs.lvl AS o, {beside("low_runs", "i")} AS s FROM leaves JOIN low_runs ON tree = name AND r = i // ({k} ** (lvl + 1))::BIGINT
      UNION ALL SELECT rid, 1000 + high_runs.lvl, {beside("high_runs", "b.i")}
        FROM leaves a JOIN subroots b ON b.name = a.name JOIN high_runs ON r = b.i // ({k} ** (lvl + 1))::BIGINT),
    paths AS (SELECT rid, list(s ORDER BY o) AS p FROM steps GROUP BY rid),
    folded AS (SELECT a.rid, a.doc_id, a.h AS leaf, b.h AS subroot, (SELECT max(h) FROM high WHERE n = 1) AS root,
      sha256(replace(array_to_string(coalesce(p, []), ''), '@', '')) AS proof_sha256,
      list_reduce(coalesce(p, []), lambda node, s: sha256(split_part(s, '@', 1) || node || split_part(s, '@', 2)), coalesce(other, a.h)) AS folded_root
      FROM leaves a JOIN subroots b ON b.name = a.name LEFT JOIN paths ON paths.rid = a.rid)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


def rank_order_languages() -> str:
    """N-grams of all words, ranked per language and per document."""
    size, grams = language.PROFILE, range(1, language.LONGEST + 1)
    held = f"coalesce({crc32('doc_id')} % 3 = 1, false)"
    cut = " UNION ALL ".join(f"SELECT rid, substr(w, i::INT, {n}) AS g, c FROM (SELECT *, unnest(range(1, len(w) + {2 - n})) AS i FROM words) q" for n in grams)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, lang, {held} AS held FROM documents),
    words AS (SELECT rid, ' ' || w || ' ' AS w, count(*) AS c FROM (SELECT rid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS w FROM d) q GROUP BY ALL),
    counted AS MATERIALIZED (SELECT rid, g, sum(c) AS n FROM ({cut}) q WHERE g <> ' ' GROUP BY ALL),
    own AS MATERIALIZED (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, g) AS r FROM counted QUALIFY r <= {size}),
    taught AS (SELECT lang, g, sum(n) AS n FROM counted JOIN d USING (rid) WHERE lang IS NOT NULL AND doc_id IS NOT NULL AND NOT held GROUP BY ALL),
    known AS MATERIALIZED (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS r FROM taught QUALIFY r <= {size}),
    near AS (SELECT rid, lang, sum({size} - abs(own.r - known.r)) AS near FROM own JOIN known USING (g) GROUP BY ALL),
    sizes AS (SELECT rid, count(*) AS m FROM own GROUP BY rid),
    apart AS (SELECT rid, lang, m, {size} * m - coalesce(near, 0) AS far FROM (SELECT * FROM sizes CROSS JOIN (SELECT DISTINCT lang FROM known)) q LEFT JOIN near USING (rid, lang)),
    best AS (SELECT rid, m, min(far) AS far, arg_min(lang, (far, lang)) AS lang FROM apart GROUP BY ALL)
    SELECT doc_id, held AS held_out, CASE WHEN b.lang IS NULL OR NOT regexp_matches(text, '\\p{{L}}') THEN '{language.UNKNOWN}' ELSE b.lang END AS lang_pred,
      CASE WHEN b.lang IS NULL OR NOT regexp_matches(text, '\\p{{L}}') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - far::DOUBLE / (m * {size})::DOUBLE END AS score
    FROM d LEFT JOIN best b USING (rid)"""


def clustered_vectors() -> str:
    """The rounds one after another, every vector against every centroid."""
    k, parts = clustering.CENTROIDS, clustering.COMPONENTS
    apart = f"list_sum(list_transform(range(1, {parts + 1}), lambda j: (v.e[j] - c.e[j]) * (v.e[j] - c.e[j])))::BIGINT"
    steps = []
    for r in range(clustering.ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, min(d) AS d, arg_min(k, (d, k)) AS k FROM (SELECT v.rid, c.k, {apart} AS d FROM v, c{r} c) q GROUP BY rid)""")
        if r < clustering.ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN
              (SELECT k, list(floor_mean ORDER BY j) AS e FROM (SELECT k, j, (sum(e[j]) - (sum(e[j]) % count(*) + count(*)) % count(*)) // count(*) AS floor_mean
                FROM a{r} JOIN v USING (rid), range(1, {parts + 1}) t(j) GROUP BY k, j) q GROUP BY k) m ON m.k = c.k)""")
    last = clustering.ROUNDS
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE len(embedding) = {parts} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{clustering.SALT}' || vec_id::VARCHAR) NULLS LAST, e) - 1 AS k, e FROM v QUALIFY k < {k}),
    {", ".join(steps)}
    SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(c.e, ',')) AS centroid_sha256
    FROM a{last} JOIN v USING (rid) JOIN c{last} c USING (k)"""


ORACLES = {"op1_url_filters": url_rules_and_trust(), "op4_suffix_array_dedup": repeated_bytes(),
           "op7_inverted_multi_index": linked_vectors(), "op11_merkle_manifest": merkle_proofs(),
           "op12_rank_order_language": rank_order_languages(), "op13_shallot_clustering": clustered_vectors()}
