"""The transducer against the SentencePiece library, and round trips."""

import random

import pytest
from sentencepiece import SentencePieceProcessor

from surety.llm import sentencepiece_fst as fst
from surety.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
FIXED = ["", " ", "  ", "a  b", "a\nb\tc", "▁a▁▁b", "▁", "é日本😀", "<s>x</s>", "<0x41>", "     a", "\x00a", "a\xa0b", "<unk>", "a ", "a   ", " \n b", "a \nb",
         "a\n b", "\n", "\n\n", "\n\na\n\n b", " " * 40, "a" + " " * 17 + "b", "https://www.example.com/foo?bar=1&x=yyyyy", "the the the", "x" * 3000]


def texts():
    rng = random.Random(1)
    machine = fst.transducer(PATH)
    out = list(FIXED)
    out += ["".join(rng.choices("abcdefgh▁  \n\tééñ日aaeeiot", k=rng.randint(1, 60))) for _ in range(800)]
    out += ["".join(rng.choices(machine.surface[259:4000], k=rng.randint(1, 12))).replace("▁", " ") for _ in range(1500)]
    out += ["".join(chr(rng.choice((rng.randint(32, 126), rng.randint(160, 0x2fff), rng.randint(0x1f300, 0x1f700)))) for _ in range(rng.randint(1, 40)))
            for _ in range(500)]
    return out


def test_ids_equal_the_library():
    machine, library = fst.transducer(PATH), SentencePieceProcessor(model_file=PATH)
    probe = texts()
    for _ in range(2):
        for text, ids, want in zip(probe, machine.encode(probe), library.encode(probe)):
            assert ids.tolist() == want, text
            assert machine.decode(ids) == text.replace("▁", " ")


def test_every_piece_follows_like_merging():
    machine, library = fst.transducer(PATH), SentencePieceProcessor(model_file=PATH)
    rng = random.Random(2)
    pieces = [i for i in range(259, len(machine.surface)) if "▁" not in machine.surface[i]]
    import numpy as np
    a, b = np.array(rng.choices(pieces, k=4000)), np.array(rng.choices(pieces[:3000], k=4000))
    got = machine.follows(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), got.tolist()):
        # Behind a line feed no blank sign can join them.
        want = library.encode("\n" + machine.surface[x] + machine.surface[y])[2:]
        assert ok == (want == [x, y]), (machine.surface[x], machine.surface[y])


def test_queries_and_decoding(spark):
    rows = [(i, t) for i, t in enumerate(FIXED)] + [(100, None), (None, "no id"), (1, "again"), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids")
    coded = fst.encode(df, PATH, keep_ids=True)
    out = coded.collect()
    assert len(out) == len(rows) and all(r["round_trip"] for r in out) and all(r["n_ids"] == len(r["ids"]) for r in out)
    back = sorted(fst.decode(coded, PATH).collect(), key=str)
    assert back == sorted([(i, (t or "").replace("▁", " ")) for i, t in rows], key=str)
    assert fst.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), PATH).first()["text"] is None
    assert fst.encode(df.limit(0), PATH).count() == 0


def changed(tmp_path, change):
    """The public model's vocabulary under other settings."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    change(model)
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def unigram(model):
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        # Sums stay exact, also in the library's single precision: no piece is as good as forbidden.
        p.score = max(p.score, -32000.0) / 64 - 3 * (len(p.piece) < 3) if p.type == 1 else p.score


def squeezing(model):
    model.normalizer_spec.remove_extra_whitespaces = True


def bare(model):
    model.normalizer_spec.add_dummy_prefix = False


@pytest.mark.parametrize("change", [[unigram], [squeezing], [unigram, squeezing], [bare], [unigram, bare, squeezing]])
def test_other_settings_equal_the_library(tmp_path, change):
    path = changed(tmp_path, lambda model: [c(model) for c in change])
    machine, library = fst.Transducer(path), SentencePieceProcessor(model_file=path)
    probe = texts()
    differ = 0
    for text, ids, want in zip(probe, machine.encode(probe), library.encode(probe)):
        assert ids.tolist() == want, text
        differ += want != SAME.encode(text)
    assert differ > 20


SAME = SentencePieceProcessor(model_file=PATH)


def test_the_path_of_least_weight_is_taken(tmp_path):
    """Against the least weight of all ways through a word."""
    machine = fst.Transducer(changed(tmp_path, unigram))
    rng = random.Random(3)
    for _ in range(60):
        word = "".join(rng.choices("aeinrst", k=rng.randint(1, 9)))

        def least(rest):
            return min((machine.cost[machine.id_of[rest[:k]]] + least(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in machine.id_of),
                       default=0.0)
        ids, _ = machine.compose([word])
        assert machine.cost[ids].sum() == least(word)


def user_piece(model):
    model.pieces[300].type = fst.USER


def charsmap(model):
    model.normalizer_spec.precompiled_charsmap = b"x"


def word_model(model):
    model.trainer_spec.model_type = 3


def crossing(model):
    model.pieces[300].piece = "a▁b"


@pytest.mark.parametrize("change", [user_piece, charsmap, word_model, crossing])
def test_other_models_are_refused(tmp_path, change):
    with pytest.raises(ValueError):
        fst.Transducer(changed(tmp_path, change))
