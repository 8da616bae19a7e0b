import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import grammar, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
KEPT = []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(0, 400), st.integers(0, 60))
def test_every_range_of_a_shard_comes_back(ids, start, n):
    ids = np.array(ids, np.uint32)
    shard = grammar.Shard(grammar.pack([len(ids)], ids, 7))
    assert shard.ids().tolist() == ids.tolist()
    assert shard.read(start, n).tolist() == ids[start : start + n].tolist()
    expanded = [len(shard.expand(np.array([7 + k], np.uint32))) for k in range(len(shard.rules))]
    assert expanded == shard.lengths.tolist()


def test_repeated_pairs_become_rules():
    ids = np.tile(np.arange(16, dtype=np.uint32), 500)
    rules, lengths, symbols = grammar.compress(ids, 16)
    assert len(symbols) < len(ids) / 8 and lengths.max() >= 8
    assert all(a < 16 + k and b < 16 + k for k, (a, b) in enumerate(rules))


def test_words_are_encoded_as_the_library_encodes_texts(docs):
    library, words = Tokenizer.from_file(PATH), tokens.WordIds(PATH)
    texts = [r.text for r in docs.collect()]
    texts += ["it's don't <|endoftext|>x áb ẞ İstanbul ΣΑΣ.  \x1c\x1d ab\x85cd 12.5 ²½ ___ a_b ...!? x;y ,,a ﬁ", " \n\t", ""]
    for text in texts:
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents_in_order_from_the_files(spark, docs, odd, none, folder, monkeypatch):
    library = Tokenizer.from_file(PATH)
    for number, df in enumerate((docs.repartition(5, "text"), odd, none)):
        path = f"{folder}/{number}"
        tokens.write_ids(df, path, PATH, 2)
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_ids(spark, path).collect()))
        given = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()))
        assert [g[1] for g in got] == [i if known else None for known, i, _ in given]
        start, sizes = 0, {}
        for known, name, text in given:
            ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
            sizes.setdefault((known, name), set()).add((len(ids), zlib.crc32(ids.tobytes())))
        for at, name, n, crc in got:
            assert at == start and (n, crc) in sizes[name is not None, name or 0]
            start += n
    some = docs.where("doc_id = 7").first()
    ids = library.encode(some.text, add_special_tokens=False).ids + [2]
    row = tokens.read_range(spark, f"{folder}/0", 7, 5, 20).first()
    assert row.ids == ids[5:25]


def test_words_of_all_kinds_and_the_texts_of_a_column():
    library, words = Tokenizer.from_file(PATH), tokens.WordIds(PATH)
    letters = [chr(c) for c in range(0x80, 0x250) if chr(c).isalpha()]
    texts = [f"{c} a{c} {c}B{c}& {c}'s ab{c}##" for c in letters]
    texts += ["Öl### 4401553578478930 12&& 7. don't' x'' ''s 's's <| |> a<|endoftext|> <|endoftext|># ½ 3é é3 ́a á&", None, "", " \t", "x\x0b\x0cy  "]
    texts += ["ab" * 90 + " " + "Ä" * 120 + "!"] * 2
    column = pa.concat_arrays([pa.array(["before"]), pa.array(texts, pa.string())]).slice(1)
    for text, ids in zip(texts, words.encode_all(column)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_words_are_encoded_together_and_only_once(docs):
    words, asked = tokens.WordIds(PATH), []
    words.words.make = lambda word, make=words.words.make: asked.append(word) or make(word)
    words.words.limit = 0  # nothing is remembered
    texts = ["the same word the same Word"] * 50
    words.encode_all(pa.array(texts))
    assert len(asked) == 5  # the, same, word, Word and its lower case


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=12), min_size=1, max_size=4))
def test_any_texts_are_encoded_as_the_library_encodes_them(texts):
    library = Tokenizer.from_file(PATH) if not KEPT else KEPT[0]
    KEPT[:] = KEPT or [library, tokens.WordIds(PATH)]
    for text, ids in zip(texts, KEPT[1].encode_all(pa.array(texts, pa.string()))):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
