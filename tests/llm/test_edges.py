"""Every registered query on tables without rows, and on tables with nulls in every column, repeated rows and further columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.queries import QUERIES

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string",
}
ALL = QUERIES | {"pipeline": corpus_pipeline.run}


def some(kind, k):
    return k if kind in ("long", "int") else f"word{k} and <p>some</p> more of it {'again ' * k}"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")
    for name, schema in TABLES.items():
        kinds = [c.split()[1] for c in schema.split(", ")]
        rows = [tuple(some(kind, k % 7) if kind != "int" else int(k % 7 == 3) for kind in kinds) for k in range(20)]
        rows += [tuple(None if j == c else x for j, x in enumerate(rows[c])) for c in range(len(kinds))] + [(None,) * len(kinds)] * 2 + rows[:3]
        df = spark.createDataFrame(rows, schema)
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
        df.write.parquet(f"{root}/plain/{name}.parquet")
        df.withColumns({c: F.lit("x") for c in ("size", "rank", "row", "chunk", "n", "label", "at", "kept", "piece", "blob", "number", "_cut", "_within", "held_out", "score", "class", "query", "prints", "is_query", "n_words", "kind", "cls", "token", "start", "length", "sha", "norm", "keep_id", "part", "border", "carried", "conv", "said", "place", "_id", "segment", "chunk_id", "pairs", "numbers", "fault")}).write.parquet(f"{root}/nulls/{name}.parquet")
    return root, {name: len(TABLES[name].split(", ")) + 25 for name in TABLES}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, folders, name):
    assert ALL[name](spark, f"{folders[0]}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(ALL))
def test_nulls_and_repeated_rows(spark, folders, name):
    """Rows for all rows of the table, and the same values whatever further columns there are. Which of equal pieces is placed where is free."""
    out = ALL[name](spark, f"{folders[0]}/nulls")
    rows = out.collect()
    n = sum(r["kind"] == "recording" for r in rows) if name.startswith("op10_") else len(rows)
    if name in ("pipeline", "op6_token_counts"):
        assert n > 0
    elif name.startswith("op13_"):
        assert n == spark.read.parquet(f"{folders[0]}/nulls/conversations.parquet").select("conv_id").distinct().count()
    else:
        assert n == folders[1][{"op9": "pages", "op10": "conversations"}.get(name.split("_")[0], "documents")]
    kept = [c for c in out.columns if c not in ("sequence_id", "offset", "slot")]
    plain = ALL[name](spark, f"{folders[0]}/plain")
    assert plain.columns == out.columns
    assert sorted(str([r[c] for c in kept]) for r in rows) == sorted(str([r[c] for c in kept]) for r in plain.collect())
