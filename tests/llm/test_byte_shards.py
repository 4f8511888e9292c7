import zlib

from sluice.llm.byte_shards import byte_shards
from sluice.llm.queries import op9_byte_shards


def brute(rows, shards=8):
    out, order = [], sorted((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    total, at, slots = sum(r[2] for r in order), 0, [0] * shards
    for i, crc, size in order:
        k = min(shards - 1, (2 * at + size) * shards // (2 * total))
        out.append((i, size, crc, k, slots[k]))
        at, slots[k] = at + size, slots[k] + 1
    return out


def test_whole_table_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in op9_byte_shards(spark, sf).collect())
    assert got == sorted(brute(rows))
    sizes = [sum(r[1] for r in got if r[3] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_nulls_ties_long_texts_and_clashing_names(spark):
    rows = [(1, None), (1, ""), (2, "é" * 5), (2, "é" * 5), (3, "x" * 200000), (4, "y")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, size int, shard int, part int")
    got = sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in byte_shards(docs, 3).collect())
    assert got == sorted(brute(rows, 3))
    assert byte_shards(docs.limit(0), 3).count() == 0
