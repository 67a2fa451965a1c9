"""The registered queries and the pipeline over a small set of tables."""

from __future__ import annotations

import glob
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fieldloom.llm import decontaminate, quality, queries
from tests.llm.test_operators import check_kept, slow_tiles

ORDER = ["quality", "near-duplicates", "decontamination", "mixture", "tokens"]


@pytest.fixture(scope="session")
def tables(spark, docs, texts, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, texts[12][1])], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/en/1", "<p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return top


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, tables, name):
    got = queries.QUERIES[name](spark, tables)
    assert len(set(got.columns)) == len(got.columns) and got.count() > 0


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def copies_by_hand(rows: list[tuple[int | None, str | None, str | None]]) -> Counter:
    """(doc_id, text) and how often the mixture has it, from the definition."""
    n = Counter(s for *_, s in rows)
    weight = {s: math.sqrt(k) for s, k in n.items()}
    out = Counter()
    for d, t, s in rows:
        rate = weight[s] / sum(weight.values()) * len(rows) / n[s]
        u = (int(hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        k, term = 0, math.exp(-rate)
        total = term
        while total < u:
            k += 1
            term *= rate / k
            total += term
        out[d, t] += k
    return +out


def test_pipeline_stages_by_hand(spark, tables, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ORDER
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    before = rows_of(docs)

    field = quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    good = stages["quality"](spark, docs, tables)
    keeps = {t: s >= 0.7 for t in {t for _, t in before} for s in field.score([(t or "").encode()])}
    assert Counter(rows_of(good)) == Counter(r for r in before if keeps[r[1]])

    kept = stages["near-duplicates"](spark, docs, tables)
    check_kept(rows_of(kept), before)

    bench = [decontaminate.words(r["text"] or "") for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    short = docs.where("text is null or size(split(text, ' ')) < 400")
    clean = stages["decontamination"](spark, short, tables)
    taken = {t for _, t in rows_of(short) if any(slow_tiles(decontaminate.words(t or ""), b, min(5, len(b))) >= 0.5 * len(b) for b in bench if b)}
    assert taken and Counter(rows_of(clean)) == Counter(r for r in rows_of(short) if r[1] not in taken)

    mixed = stages["mixture"](spark, docs, tables)
    assert Counter(rows_of(mixed)) == copies_by_hand([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    for out in (good, kept, clean, mixed):
        assert out.columns == columns
    assert {r["copies"] for r in mixed.select("copies").collect()} == {9}  # the input's own column

    mixed.write.parquet(f"{tmp_path}/mixed")
    files = sorted(glob.glob(f"{tmp_path}/mixed/part-*"))
    order = [(d, t) for f in files for d, t in zip(*(pq.read_table(f).column(c).to_pylist() for c in ("doc_id", "text")), strict=True)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for d, t in order:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = stages["tokens"](spark, spark.read.parquet(f"{tmp_path}/mixed"), tables).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_pipeline_runs_and_takes_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).count() == 0, name
    kept = corpus_pipeline.run(spark, tables)
    assert kept.count() > 20 and not kept.where("doc_id = 12").count()  # a benchmark item
