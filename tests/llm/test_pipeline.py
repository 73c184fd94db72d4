import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.cases import ROWS
from tests.llm.test_line_chunks import brute as without_chunks
from tests.llm.test_ngram_join import brute as near_copies

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    assert {"pipeline", *(f"op{n}" for n in range(1, 14))} <= {k.partition("_")[0] for k in entry.queries()}


def test_line_stage(spark):
    rows = [*ROWS, (40, "a 1\nb 2\nc 3", "en", "s"), (41, "a 1\nb 2\nc 3", "en", "s")]
    df = documents(spark, rows)
    kept = corpus_pipeline.unrepeated_lines(spark, df, FOLDER)
    assert kept.columns == df.columns and kept.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    expected = [(d, t) for (d, t), r in zip(without_chunks(rows), rows, strict=True) if t or not r[1]]
    key = lambda pair: (str(pair[0]), str(pair[1]))
    got = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(expected, key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_near_copy_stage(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(k, base.replace("w59", f"x{k}"), "en", "s") for k in range(9)] + [(20, base.replace("w", "v"), "en", "s")]
    kept = corpus_pipeline.one_of_near_copies(spark, documents(spark, rows), FOLDER).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({c for _, _, c in near_copies(rows)}) == ["0", "20"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not mounted")
def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER).collect()
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert 0 < len(out) < texts and all(r.decoded_ok and r.n_tokens > 0 for r in out)
    assert len({r.doc_id for r in out}) == len(out)
