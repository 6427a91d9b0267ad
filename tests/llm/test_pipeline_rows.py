import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oriscope.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("id", "n", "size", "sha", "token", "component", "score", "lang_pred", "key", "row_id", "text_hash", "maybe", "mix_key", "a.b")


def test_near_dedup_judges_each_row(spark):
    """Repeated ids with different texts, and null ids."""
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (2, f"{a} one"), (2, b), (3, f"{b} two"), (3, c), (4, f"{b} three"), (None, d), (None, f"{d} four"), (None, f"{d} five"), (None, f"{a} six"), (None, e), (9, f"{e} seven"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    of_d = [x for x in kept if x[1] and x[1].startswith(d)]
    assert len(of_d) == 1
    want = [(1, a), (2, b), (3, c), (9, f"{e} seven"), (None, None), (None, ""), *of_d]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def odd_documents(spark):
    """Null and repeated ids, repeated rows, null, empty and very long texts, and columns of names that stages use."""
    r = random.Random(9)
    say = lambda n: " ".join(r.choice("the of and that with from this have shall ought which under".split()) + str(r.randrange(9)) for _ in range(n))
    rows = [(i, say(60), "en", f"s{i % 3}", None) for i in range(60)]
    rows += [(None, say(50), "en", None, None), (None, None, "en", "s0", None), (70, "", "en", "s0", None), (71, "12 34", None, None, None), (5, say(40), "en", "s1", None), (None, rows[3][1], None, "s2", 9), rows[4], rows[4]]
    rows += [(80, " ".join(f"w{i}" for i in range(300_000)) + rows[0][1], "en", "s1", None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return rows, df.withColumns({c: F.lit("x") for c in CLASHING}).withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))


def test_stages_on_odd_rows(spark, tmp_path):
    rows, docs = odd_documents(spark)
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        out = stage(spark, docs, str(tmp_path))
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        texts[name] = sorted((str(x.doc_id), x.text or "") for x in docs.collect()) if name != "bpe" else docs.collect()
    assert texts["language_id"] == sorted((str(i), t) for i, t, *_ in rows if t and any(c.isalpha() for c in t))
    last = {}
    for i, t, *_ in rows:
        if t and any(c.isalpha() for c in t):
            last[t] = max(last.get(t, -1), -1 if i is None else i)
    want = sorted((str(None if i < 0 else i), t) for t, i in last.items())
    assert texts["exact_dedup"] == want
    assert texts["near_dedup"] == want  # of other words each
    assert set(texts["mix"]) <= set(want)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    assert sorted(r.n_tokens for r in texts["bpe"]) == sorted(len(library.encode(t, add_special_tokens=False).ids) for _, t in texts["mix"])


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_of_empty_and_wordless_tables(spark, name, stage):
    _, docs = odd_documents(spark)
    assert stage(spark, docs.limit(0), "").count() == 0
    none = docs.filter("text is null or text = ''")
    left = {"language_id": 0, "exact_dedup": 1, "near_dedup": 2, "mix": 0, "bpe": 2}
    assert stage(spark, none, "").count() == left[name]
