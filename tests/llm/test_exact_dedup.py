import hashlib

import pytest
from llm.edge_rows import ROWS, ascii_lower, documents

from renderscope.llm import exact_dedup


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(ascii_lower(r[1]), []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("key_bits,bucket", [(64, 50_000), (64, 2), (2, 3)])
def test_groups(spark, key_bits, bucket):
    got = exact_dedup.duplicate_groups(documents(spark), key_bits=key_bits, bucket_entries=bucket)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(ROWS)


def test_directory_doubles(spark):
    rows = [(i, f"text {i}", "en", "s", 1, "x") for i in range(500)]
    index = exact_dedup.build_index(documents(spark, rows=rows), bucket_entries=20)
    held = {r.bucket: r["count"] for r in index.entries.groupBy("bucket").count().collect()}
    assert len(held) > 16 and max(held.values()) <= 20
    cells = [r.cell for r in index.directory.collect()]
    assert sorted(cells) == list(range(1 << index.global_depth))


def test_drop_copies_keeps_columns(spark):
    docs = documents(spark, "keep_id string")
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {2, 5, 4, 6, 7, 9, 10, 11, 12, 13, 14, 15, None}


def test_empty(spark):
    assert exact_dedup.duplicate_groups(documents(spark).limit(0)).collect() == []
