"""Chunk coder against the library on whole texts, with and without shared cores."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from claimforge.llm import bpe_chunks as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    return lib


def odd_texts():
    rnd = random.Random(3)
    texts = ["", "   ", "a", "a" * 20_000, ("ab" * 300 + " ") * 40, "x\n\n\ny  z " * 900, "é́ Ünï \xa0 nbsp   em " * 400]
    texts += ["pre<|endoftext|>post " * 300, "<|endo ftext|> " * 300, " ́e" * 900, "日本語テキスト" * 900, "'s don't I'll " * 400]
    return texts + ["".join(rnd.choice(" \n\tabcé'1.,<|>́\xa0") for _ in range(rnd.randint(1, 6000))) for _ in range(40)]


def test_ids_are_the_librarys(library):
    texts = odd_texts()
    coder = B.ChunkCoder(PATH, {})
    for _ in range(2):  # the second time from the worker's table
        ids, ends = coder.encode(pa.array(texts))
        for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[ends[i] : ends[i + 1]].tolist() == e.ids


def test_cuts_follow_the_content():
    rnd = random.Random(5)
    shared = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    cut = B.cut_texts(pa.array(["one " * 77 + shared, "something else " * 31 + shared]))
    cores = cut.strings(cut.core_first, cut.core_end).to_pylist()
    mine = [{c for c, t in zip(cores, cut.text.tolist()) if t == i} for i in (0, 1)]
    assert len(mine[0] & mine[1]) >= len(mine[0]) - 3 > 5


def test_a_wrong_shared_core_is_not_agreed_to(library):
    # Ids that disagree with the words around a join make the join take in more, at last the whole text.
    text = " ".join(f"word{i} and more" for i in range(400))
    cut = B.cut_texts(pa.array([text]))
    core = cut.strings(cut.core_first, cut.core_end)[0].as_py()
    coder = B.ChunkCoder(PATH, {core: np.zeros(200, "<u4")})
    ids, _ = coder.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_operator_rows(spark, library):
    long = " ".join(f"token {i} of a passage that stands in two texts" for i in range(500))
    rows = [(1, long, "a"), (2, "other start " + long, "b"), (3, None, "c"), (None, "plain", "d"), (1, long, "a"), (5, "", None), (6, "a<|endoftext|>b", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in B.encode_and_decode(df, PATH).collect()), key=str)
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert B.encode_and_decode(df.limit(0), PATH).collect() == []


def test_shared_cores_are_found(spark):
    rnd = random.Random(7)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    df = spark.createDataFrame([(i, f"start {i} " * 40 + long) for i in range(6)], "doc_id long, text string")
    cores = B.shared_cores(df, "text")
    assert len(cores) > 5 and all(c in long for c in cores if "start" not in c)


def test_a_large_batch_is_coded_in_parts(library, monkeypatch):
    monkeypatch.setattr(B, "PART_BYTES", 20_000)
    rnd = random.Random(11)
    texts = [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 400))) for _ in range(300)] + [None, "", "word " * 9000]
    coder, asked = B.ChunkCoder(PATH, {}), []
    encode = coder.encode
    monkeypatch.setattr(coder, "encode", lambda t: asked.append((len(t), sum(map(len, t.to_pylist())))) or encode(t))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["_key", "_text"])
    got = [r for part in B.coded_parts(coder, iter([batch])) for r in part.to_pylist()]
    assert [r["_key"] for r in got] == list(range(len(texts)))
    assert [r["ids"] for r in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert all(n == 1 or size < 20_000 + 1600 for n, size in asked) and len(asked) > 10


def test_the_rolling_hash_holds_little_besides_itself():
    data = np.random.default_rng(1).integers(0, 256, 1 << 20, dtype=np.uint8)
    tracemalloc.start()
    B.rolling_hash(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 8 * len(data)
