import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barline.llm import token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sZ19 .!,%é\n\n  \t\r\x0b 　é漢-")), max_size=30), min_size=1, max_size=4))
def test_pieces_equal_whole_encoding(texts):
    encoder = token_store.encoder(PATH)
    encoder.clear()
    got = encoder(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "endoftext", " ", "\n", "  ", "ab", "é", "'s", "1."]), max_size=12).map("".join), min_size=1, max_size=4))
def test_added_tokens_equal_whole_encoding(texts):
    encoder = token_store.encoder(PATH)
    encoder.clear()
    got = encoder([*texts, "x <|endoftext|> y"])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [*(ids(t) for t in texts), [87, 220, 50256, 331]]


def test_files(spark, tmp_path):
    docs = [(5, "the cat sat on the mat\nand it's 42"), (1, None), (9, ""), (3, "  odd   spaces \n\n here "), (3, "same id"), (None, "no id"), (12, "long " * 30_000), (7, "x\ny"), (7, "x\ny")] + [(k, f"document number {k}") for k in range(20, 60)]
    spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, shard string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in token_store.op10_token_store(spark, str(tmp_path)).orderBy("start").collect()]
    want, start = [], 0
    full = [(d, np.array([*ids(t or ""), 2], "<u4")) for d, t in docs]
    for d, x in sorted(full, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(r[1].tobytes()))):
        want.append((d, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want


def test_short_access(spark, tmp_path):
    d = spark.createDataFrame([(k, f"text {k} " * (k % 7)) for k in range(200)], "doc_id long, text string")
    token_store.write_tokens(d, f"{tmp_path}/t", PATH, shards=3)
    got = {r.doc_id: r.ids for r in token_store.read_tokens(spark, f"{tmp_path}/t", only=[17, 190], ids=True).collect()}
    assert got == {k: [*ids(f"text {k} " * (k % 7)), 2] for k in (17, 190)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert token_store.op10_token_store(spark, str(tmp_path)).count() == 0


def test_files_roll_and_shards_follow_the_bytes(spark, tmp_path, monkeypatch):
    """A shard of many blocks is several files; the result is the same as from one."""
    import public_tokenizers

    rows = [(k, f"document {k} " * (40 + k)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = []
    for block, file_blocks, shard in ((4 << 20, 48, 16 << 20), (600, 2, 4_000)):
        for name, value in (("BLOCK_BYTES", block), ("FILE_BLOCKS", file_blocks), ("SHARD_BYTES", shard), ("TASK_BYTES", 10 * shard)):
            monkeypatch.setattr(token_store, name, value)
        path = f"{tmp_path}/{block}"
        token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
        made.append(sorted(map(tuple, token_store.with_starts(token_store.read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())))
        files = list((tmp_path / str(block) / "blocks").glob("*/part-*"))
        assert len(files) == 1 if block > 600 else len(files) > 2
    assert made[0] == made[1] and len(made[0]) == 120


def test_a_lookup_opens_only_the_files_that_can_hold_it(spark, tmp_path):
    d = spark.createDataFrame([(k, f"text {k} " * 3) for k in range(0, 4000, 2)] + [(None, "no id")], "doc_id long, text string").repartition(4)
    token_store.write_tokens(d, f"{tmp_path}/t", PATH, shards=40)
    everything = list((tmp_path / "t" / "blocks").glob("*/part-*"))
    read = lambda only: token_store.block_files(spark, f"{tmp_path}/t", only)
    assert len(everything) >= 8 and read(None).count() == len(everything)
    for only in ([0], [1998], [3998], [0, 2], [777]):
        assert 1 <= read(only).count() <= 2
        got = token_store.read_tokens(spark, f"{tmp_path}/t", only=only, ids=True).collect()
        assert {r.doc_id: r.ids for r in got} == {k: [*ids(f"text {k} " * 3), 2] for k in only if k % 2 == 0}
    assert read([0, 3998]).count() < len(everything)
