"""Token files: rows that share a key, null keys, many parts, indexes in the files."""

import random
import zlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm.queries import word_bpe
from evidentia.llm.token_files import encode_sorted, token_positions, write_tokens


def test_starts_are_those_of_the_files(spark, tmp_path):
    """Ids are read file by file, and cut where the query says."""
    rng = random.Random(2)
    rows = [(1, "three short words of it"), (1, "a"), (1, "b c d e f"), (None, "no key"), (None, None), (None, "zz no key either"), (2, "")]
    rows += [(7, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(9)))) for _ in range(300)]
    path = str(tmp_path / "tokens")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("ids", F.lit("clash"))
    write_tokens(encode_sorted(docs, word_bpe(), 1), path)
    files = sorted(r[0] for r in spark.read.orc(path).select("_metadata.file_path").distinct().collect())
    flat, keys = [], []
    for f in files:
        for r in spark.read.orc(f).orderBy("row").collect():
            flat += r["ids"]
            keys.append(r["doc_id"])
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert len(files) > 2  # the many texts of one key are in several files
    got = token_positions(spark, path).collect()
    for r in got:
        ids = flat[r["start"] : r["start"] + r["n_tokens"]]
        assert ids[-1] == 1 and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    assert sorted(r["start"] for r in got) == [k and p for k, p in enumerate([0, *(i + 1 for i, x in enumerate(flat) if x == 1)][:-1])]
    library = Tokenizer.from_file(word_bpe())
    assert sum(r["n_tokens"] for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_parts_beyond_five_digits(spark, tmp_path):
    """part-100000 follows part-99999."""
    path = tmp_path / "tokens"
    rows = spark.createDataFrame([(k, [9] * (k + 1), 0) for k in range(3)], "doc_id long, ids array<int>, row long")
    names = ["part-00002-x.orc", "part-99999-x.orc", "part-100000-x.orc"]
    path.mkdir()
    for k, name in enumerate(names):
        one = str(tmp_path / f"one{k}")
        rows.where(F.col("doc_id") == k).coalesce(1).write.orc(one)
        next((tmp_path / f"one{k}").glob("*.orc")).rename(path / name)
    got = {r["doc_id"]: r["start"] for r in token_positions(spark, str(path)).collect()}
    assert got == {0: 0, 1: 1, 2: 3}


def test_files_hold_bloom_filters_and_row_indexes(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(500)], "doc_id long, text string")
    write_tokens(encode_sorted(docs, word_bpe(), 1), path)
    file = spark.read.orc(path).select("_metadata.file_path").first()[0]
    jvm, gate = spark._jvm, spark.sparkContext._gateway
    orc = jvm.org.apache.orc.OrcFile
    reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(file), orc.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 10_000 and reader.getCompressionKind().toString() == "ZSTD"
    names = list(reader.getSchema().getFieldNames())
    every = gate.new_array(jvm.boolean, len(names) + 3)
    for k in range(len(every)):
        every[k] = True
    rows = reader.rows()
    index = rows.readRowIndex(0, every, every)
    column = names.index("doc_id") + 1
    assert index.getRowGroupIndex()[column].getEntryCount() == 1
    assert index.getBloomFilterIndex()[column].getBloomFilterCount() == 1
    assert index.getBloomFilterIndex()[names.index("row") + 1] is None
    rows.close()
