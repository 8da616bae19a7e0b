import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidewatch.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_paths_are_what_the_library_gives(docs, library):
    machine = pieces.Machine(MODEL)
    texts = [r.text for r in docs.collect()]
    rng = random.Random(5)
    marks = "  aeth e▁ 日本\t\n\x00\x01éèǅ😀0123<>/s.,'’ ﬁ"
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [" " * rng.randrange(70) + "hello" + " " * rng.randrange(50) + "worldly" for _ in range(300)]
    for text in texts:
        ids = machine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
        assert machine.decode(ids) == library.decode(library.encode(text))


def test_least_path_of_a_unigram_model(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = pieces.UNIGRAM
    rng = random.Random(3)
    for p in model.pieces:
        if p.type == pieces.NORMAL:
            p.score = -rng.uniform(5, 15)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as file:
        file.write(model.SerializeToString())
    machine = pieces.Machine(path)

    def best(text):  # every way to cut a short word
        if not text:
            return 0.0
        return max(
            machine.scores[machine.ids[text[:k]]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in machine.ids
        )

    for word in ("▁hello", "there", "ation", "▁the", "internat", "▁▁▁x"):
        assert sum(machine.scores[p] for p in machine.shortest(word)) == pytest.approx(best(word))


def test_rows_come_back_whole(odd, none, library):
    rows = pieces.encode(odd, MODEL, ["doc_id", "n"]).collect()
    given = odd.select("doc_id", "text").collect()
    assert len(rows) == len(given)
    texts = {(r.doc_id, r.text) for r in given}
    for r in rows:
        assert r.ids == library.encode(r.decoded if r.round_trip else next(t for i, t in texts if i == r.doc_id))
        assert r.n_tokens == len(r.ids) and r.n == 4
        assert r.round_trip or r.doc_id == 9  # U+2581 stands for a space
    assert {r.decoded for r in rows if r.doc_id in (1, 2)} == {""}
    assert pieces.encode(none, MODEL, ["doc_id"]).count() == 0
