"""Base spans against the plain patterns; the field's messages against enumeration."""

import itertools
import random
import re

import numpy as np
import pytest

from surety.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def accepts(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return [True, kind == 1 and all(int(p) <= 255 for p in m.split(".")), 16 <= len(digits) <= 19 and luhn(digits),
            8 <= len(digits) <= 15][kind]


def plain(text):
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if accepts(k, m[0])]


def card(rng):
    body = "".join(rng.choices("0123456789", k=15))
    return next(body + d for d in "0123456789" if luhn(body + d))


@pytest.mark.parametrize("seed", range(6))
def test_base_spans(seed):
    rng = random.Random(seed)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.256", "1.2.3.4.5.6.7.8", "001.002.003.004", "+1 (826) 555-4081", "+12345678", "+1-",
            "+", "é", "٣٤", "4111 1111 1111 1111", "4111-1111-1111-1111 ", " ", " ", "word", ".", "-", "@@", "%+-", "9" * 40, "a@b.c-.d", "\n", "b@c.d.e@f.g"]
    for _ in range(300):
        text = "".join(rng.choice([*bits, card(rng), str(rng.randint(0, 999))]) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@" * 50_000, "+1" * 100_000):
        pii.base_spans(text)


def test_tree_beliefs_equal_enumeration():
    rng = np.random.default_rng(2)
    k = len(pii.KINDS) + 1
    field = pii.SkipChainField(rng.normal(size=(pii.SHAPES, k)), rng.normal(size=(2, k, k)))
    edges = np.array([[0, 1, 0], [1, 2, 0], [1, 3, 1]])
    given = np.array([-1, -1, 2, -1])
    shape = rng.normal(size=(4, pii.SHAPES))
    t = pii.Tokens(np.zeros(4, int), np.zeros(4, int), np.zeros(4, int), shape, given, edges)
    want = np.zeros((4, k))
    own = shape @ field.shape
    for labels in itertools.product(range(k), repeat=4):
        if labels[2] != given[2] + 1:
            continue
        w = np.exp(sum(own[i, y] for i, y in enumerate(labels) if i != 2) + sum(field.pairs[e, labels[a], labels[b]] for a, b, e in edges))
        for i, y in enumerate(labels):
            want[i, y] += w
    assert field.beliefs(t) == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-6)


def make(rng, n):
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 40))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice([card(rng), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"{words[0]}.{i}@mail.example.com",
                               ".".join(str(rng.randint(0, 255)) for _ in range(4)), str(rng.randint(10, 10 ** 6))])
            words.insert(rng.randint(0, len(words)), item)
        rows.append((i, " ".join(words)))
    return rows


def test_base_spans_stay_and_consistency_adds(spark):
    rng = random.Random(3)
    rows = make(rng, 400)
    number = card(rng)
    rows += [(1000, f"pay {number} now and again {number} 12 ok"), (1001, None), (1002, ""), (None, "mail a@b.cd"), (1003, "x" * 9000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, spans string")
    found = pii.spans(df, pii.train(df)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    added = 0
    for r in found:
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["base"]]
        assert base == plain(texts[r["doc_id"]] or "")
        every = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"]]
        assert set(base) <= set(every) and every == sorted(every)
        added += len(every) - len(base)
    assert added < 10
    # Two cards that run together are no base match; the field finds a repeat of a known one.
    assert {(s["start"], s["end"]) for s in next(r for r in found if r["doc_id"] == 1000)["spans"]} >= {(4, 20)}


@pytest.mark.parametrize("sure,bare", [("+1 826 555 4081", "8265554081"), ("a.b@cd.ef", "A.B@")])
def test_a_sure_mention_reaches_hundreds_of_repeats(sure, bare):
    k = len(pii.KINDS) + 1
    shape, pairs = np.zeros((pii.SHAPES, k)), np.zeros((2, k, k))
    shape[0, 0] = 1.0                       # every token leans to none
    pairs[1] = 6.0 * np.eye(k)              # repeats share their label
    field = pii.SkipChainField(shape, pairs)
    for text in (f"call {sure} or " + f"ring {bare} now " * 300, f"ring {bare} now " * 300 + f"or {sure} ok"):
        raw = np.frombuffer(text.encode(), np.uint8)
        (base,), (found,) = pii.find([text], raw, np.array([0, len(raw)]), field)
        assert {text[a:b] for _, a, b in base} == {sure}
        mentions = [m.span() for m in re.finditer(re.escape(bare), text)]
        assert {(base[0][0], *m) for m in mentions} <= set(found) and len(mentions) == 300


def test_far_evidence_without_a_base_span_settles():
    k = len(pii.KINDS) + 1
    n = 300
    shape = np.zeros((n, pii.SHAPES))
    shape[:, 0], shape[0, 1] = 1, 1
    weights = np.zeros((pii.SHAPES, k))
    weights[1, 4] = 12.0                    # only the first token's shape tells
    pairs = np.zeros((2, k, k))
    pairs[1] = 12.0 * np.eye(k)
    edges = np.array([[i, i + 1, 1] for i in range(n - 1)])
    t = pii.Tokens(np.zeros(n, int), np.zeros(n, int), np.zeros(n, int), shape, np.full(n, -1), edges)
    assert pii.SkipChainField(weights, pairs).beliefs(t)[-1, 4] > 0.95


def test_training_counts_every_document(spark):
    last = {r["id"] for r in spark.range(5100).selectExpr("id", "xxhash64(id) h").orderBy("h", "id").collect()[-100:]}
    rows = [(i, "mail a@b.cd" if i in last else "12 words") for i in range(5100)]
    field = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    t = pii.tokens_of(["x@y.zz"], np.frombuffer(b"x@y.zz", np.uint8), np.array([0, 6]), [[]])
    assert field.beliefs(t)[0, 1] > 0.9


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a@b.cd, ip 1.2.3.4", "n", 25), (2, "clean", None, None), (3, None, None, 7)],
                               "doc_id bigint, text string, base string, n_chars bigint")
    out = {r["doc_id"]: r for r in pii.redact(df, pii.train(df)).collect()}
    assert out[1]["text"] == "é mail [EMAIL], ip [IP]" and out[1]["n_chars"] == len(out[1]["text"]) and out[1]["base"] == "n"
    assert out[2]["text"] == "clean" and out[2]["n_chars"] == 5 and out[3]["text"] is None and out[3]["n_chars"] == 7
    empty = df.limit(0)
    assert pii.redact(empty, pii.train(empty)).count() == 0


def test_a_log_of_many_addresses_takes_linear_time():
    """Tokens and base spans are walked together; the same labels as looking at every span for each token."""
    import time
    text = " ".join(f"user{i}@example.com +1 555 01{i % 90 + 10} 2{i % 900 + 100} 10.0.{i % 250}.1 word{i}" for i in range(4000))
    raw = np.frombuffer(text.encode(), np.uint8)
    spans = pii.base_spans(text)
    began = time.time()
    got = pii.tokens_of([text], raw, np.array([0, len(raw)]), [spans])
    assert time.time() - began < 20
    for a, b, label in list(zip(got.start.tolist(), got.end.tolist(), got.given.tolist()))[::37]:
        assert label == next((x[0] for x in spans if x[1] < b and a < x[2]), -1)
