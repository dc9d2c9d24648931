"""The pipeline's stages and the whole of it against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cmdprism.llm import jaccard, toxicity
from cmdprism.llm.common import crc_bucket

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _toxicity double, _hits string, _masked string, _source string"
STAGES = dict(corpus_pipeline.STAGES)


def own_rows(sf_docs, items):
    """Edge cases with ids from 100,000 on."""
    rng = random.Random(3)

    def words(n):
        return " ".join("".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))

    base = words(60)
    near = base.split()
    near[30] = "changed"
    mail = words(20) + " write to ann.lee@example.org or call +49 (30) 1234-5678 now"
    texts = [None, "", "...", base, base, " ".join(near), words(50), words(50), mail, words(15) + " " + items[0] + " " + words(15), words(3000)]
    return [(100_000 + i, t) for i, t in enumerate(texts)] + [(100_004, base), (None, words(30)), (None, None)]


@pytest.fixture(scope="module")
def data(spark, sf_dir, tmp_path_factory):
    """The smallest tables with edge cases and columns of clashing names."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]
    extra = [(i, t, "en", None if t is None else f"src{len(t) % 3}", None if t is None else len(t)) for i, t in own_rows(docs, items)]
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    )
    marked = every.withColumns({"_toxicity": F.lit(7.0), "_hits": F.lit("h"), "_masked": F.concat(F.lit("m"), F.coalesce("doc_id", F.lit(-1)).cast("string")), "_source": F.lit("own")})
    marked.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_toxic_documents_go(spark, data):
    folder, docs = data
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels, crc_bucket("doc_id", 4) != 2)
    scores = docs.withColumn("s", model.score(F.col("text"))).collect()
    want = [tuple(r)[:-1] for r in scores if not r["text"] or r["s"] < toxicity.THRESHOLD]
    got = rows_of(STAGES["toxicity"](spark, docs, folder))
    assert got == sorted(want, key=str) and len(got) < len(scores)
    assert sum(r[1] is None for r in got) == 2 and sum(r[1] == "" for r in got) == docs.where("text = ''").count()


def test_texts_without_words_pass_a_model_that_rejects_all(spark, data, monkeypatch):
    folder, docs = data
    monkeypatch.setattr(toxicity, "THRESHOLD", -1.0)
    kept = STAGES["toxicity"](spark, docs, folder).collect()
    assert kept and all(not r["text"] for r in kept)


def test_one_of_each_class_stays(spark, data):
    folder, docs = data
    rows = docs.collect()
    sets = []
    for r in rows:
        words = [w for w in (r["text"] or "").lower().encode().translate(jaccard.WORD_BYTES).split()]
        n = min(5, len(words))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    root[find(i)] = find(j)
    classes = {}
    for i, r in enumerate(rows):
        key = ("own", i) if not sets[i] else ("class", find(i))
        classes.setdefault(key, []).append(r)
    want = sorted((min((r["doc_id"] is None, r["doc_id"] or 0) for r in own) for own in classes.values()), key=str)
    got = STAGES["near_duplicates"](spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()), key=str) == want
    originals = {tuple(r) for r in rows}
    assert all(tuple(r) in originals for r in got.collect())


def test_contaminated_documents_go(spark, data):
    folder, docs = data
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        words = plain_words(r["text"])
        n = min(10, len(words))
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        words = plain_words(text)
        return not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    want = [tuple(r) for r in docs.collect() if clean(r["text"])]
    got = rows_of(STAGES["decontamination"](spark, docs, folder))
    assert got == sorted(want, key=str) and len(got) < docs.count()


def test_personal_data_is_masked(spark, data):
    folder, docs = data
    before = {r["_masked"] + str(r["text"])[:0]: r for r in docs.where("doc_id IS NOT NULL AND doc_id <> 100004").collect()}
    out = STAGES["personal_data"](spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count()
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    changed = 0
    for r in out.collect():
        assert email.search(r["text"] or "") is None
        old = before.get(r["_masked"])
        if old is None:
            continue
        assert (r["source"], r["lang"], r["_hits"]) == (old["source"], old["lang"], old["_hits"])
        if r["text"] == old["text"]:
            assert r["n_chars"] == old["n_chars"]
        else:
            changed += 1
            assert r["n_chars"] == len(r["text"]) and re.search(r"\[[A-Z]+\]", r["text"])
    assert changed >= 1
    mail = out.where("doc_id = 100008").first()["text"]
    assert "[EMAIL]" in mail and "[PHONE]" in mail and "1234" not in mail


def test_the_mix_holds_every_document(spark, data):
    folder, docs = data
    out = STAGES["mixing"](spark, docs, folder)
    assert set(docs.columns) <= set(out.columns)
    counts = {}
    for r in out.collect():
        counts.setdefault((r["_masked"], r["text"], r["epoch"]), 0)
        counts[r["_masked"], r["text"], r["epoch"]] += 1
    originals = {}
    for r in docs.collect():
        originals[r["_masked"], r["text"]] = originals.get((r["_masked"], r["text"]), 0) + 1
    assert all(counts[(*key, 0)] == n for key, n in originals.items())


def test_run_applies_all_stages(spark, data):
    folder, docs = data
    want = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = spark.createDataFrame(stage(spark, want, folder).collect(), docs.schema)
    got = corpus_pipeline.run(spark, folder)
    first = got.where("epoch = 0").select(*docs.columns)
    assert rows_of(first) == rows_of(want)
    assert got.count() >= want.count()
    clean = {100_000, 100_001, 100_002, 100_006, 100_007, 100_010}
    assert clean <= {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    assert got.where("doc_id IN (100004, 100005, 100009)").count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_documents(spark, data, name):
    folder, docs = data
    empty = spark.createDataFrame([], docs.schema)
    assert STAGES[name](spark, empty, folder).collect() == []


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])
