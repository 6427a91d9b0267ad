import random

import corpus_pipeline
from oriscope.llm.queries import tokenizer_path
from tests.llm.test_dedup_join import components
from tests.llm.test_mix_shards_urls import targets


def corpus(spark, folder):
    r = random.Random(8)
    words = {"en": "the of and that with from this have shall ought".split(), "de": "der die und nicht auch mit schön über sehr".split()}
    rows = []
    for i in range(200):
        lang = r.choice(["en", "de"])
        rows.append((i, " ".join(r.choice(words[lang]) + r.choice(["", "", "er", "st"]) for _ in range(r.choice([6, 40, 150]))), lang, f"src{i % 3}" if i % 11 else None, None))
    rows += [(300 + i, rows[i][1], "en", "src0", None) for i in range(12)]
    rows += [(400 + i, rows[i][1] + " tail", "en", "src1", None) for i in range(6)]
    rows += [(500, None, "en", "src0", None), (501, "123 ++ 456", "de", "src0", None), (502, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix", "bpe"]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = docs.collect()
    letters = {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in held["language_id"]} == letters
    keep = {}
    for i, t, *_ in rows:
        if i in letters:
            keep[t] = max(i, keep.get(t, i))
    assert sorted(r.doc_id for r in held["exact_dedup"]) == sorted(keep.values())
    reach = components([(r.doc_id, r.text) for r in held["exact_dedup"]], 5, 80)
    assert sorted(r.doc_id for r in held["near_dedup"]) == sorted(i for i, (_, c) in reach.items() if i == c)
    before = {r.doc_id: r for r in held["near_dedup"]}
    size, target = targets([(r.doc_id, r.text, None, r.source) for r in before.values()])
    taken, largest, times = dict.fromkeys(size, 0), dict.fromkeys(size, 0), {}
    for r in held["mix"]:
        n = len(r.text.split())
        taken[r.source] += n
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for r in before.values():
        largest[r.source] = max(largest[r.source], len(r.text.split()))
    assert max(times.values()) <= 2
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in held["mix"])
    assert sorted((r.doc_id, r.n_tokens) for r in held["bpe"]) == want
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, held["bpe"]))
