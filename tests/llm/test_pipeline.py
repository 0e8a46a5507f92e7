"""The pipeline: every stage on its own input, and the whole against what its stages promise."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from test_llm_operators import BruteSurrogates, brute_rules
from test_llm_operators import brute_classes as brute
from tidegraph.llm import jaccard, rules
from tidegraph.llm.common import stage
from tidegraph.llm.mixing import poisson_cdf
from tidegraph.llm.tokens import vocabulary_path


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        kept.append(docs)
    good, single, clean, mixed = kept
    want = {r["doc_id"] for r in rules.apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == want
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    firsts = {c for _, c, _ in brute(rows)}
    assert {r["doc_id"] for r in single.collect()} == firsts and single.count() == len(firsts)
    assert {r["doc_id"] for r in clean.collect()} == firsts
    assert {r["doc_id"] for r in mixed.collect()} <= firsts
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, sf_dir)
    pieces = Counter(r["doc_id"] for r in packed.filter("start = 0").collect())
    assert pieces == Counter(r["doc_id"] for r in mixed.collect())
    assert packed.count() == corpus_pipeline.run(spark, sf_dir).count()


def test_near_copies_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    classes = jaccard.join(docs)
    assert jaccard.keep_one(docs).count() == classes.select("class_id").distinct().count()


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) + (" the" if i % 9 == 0 else "") for i in range(n))


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, ids of several texts and columns of clashing names, through all stages."""
    long = words(50, 30_000)
    rows = [(1, words(1, 80)), (1, words(1, 80)), (2, words(1, 80)), (2, words(2, 90)), (None, words(3, 70)), (None, None), (3, None), (4, ""), (5, " \n"), (6, long), (7, long + " more"), (8, "a@b.com " + words(8, 60))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, __count long, maybe string, start long, own string"
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", 1, "r", 5, "m", 9, "o") for k, (i, t) in enumerate(rows)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = docs
    kept = []
    for _, function in corpus_pipeline.STAGES[:-1]:
        got = stage(function(spark, got, str(tmp_path)), "odd")
        assert got.columns == docs.columns
        kept.append(Counter(r["doc_id"] for r in got.collect()))
        assert all((r["row"], r["__count"], r["maybe"], r["start"], r["own"]) == ("r", 5, "m", 9, "o") for r in got.collect())
    assert kept[0] == Counter({1: 2, 2: 2, None: 1, 6: 1, 7: 1, 8: 1})
    assert kept[1] == kept[2] == Counter({1: 1, 2: 1, None: 1, 6: 1, 8: 1})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out if r["start"] == 0) == kept[3]
    empty = f"{tmp_path}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_whole_against_brute_force(spark, sf_dir):
    """run() against the stages in plain Python: rules, all pairs, surrogates, Poisson draws, the library's ids."""
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in source if r["text"] is not None and brute_rules(r["text"])["kept"]]
    firsts = {c for _, c, _ in brute([(i, t) for i, t, _ in rows])}
    rows = [r for r in rows if r[0] in firsts]
    replaced = BruteSurrogates("tide|round0")
    rows = [(i, replaced.replace(t)[0], s) for i, t, s in rows]
    sizes = Counter(s for _, _, s in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    library, want = Tokenizer.from_file(vocabulary_path()), Counter()
    for i, t, s in rows:
        u = (int(hashlib.md5(f"7|{i}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        count = sum(c <= u for c in poisson_cdf(sum(sizes.values()) * math.sqrt(sizes[s]) / total / sizes[s]))
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[(i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += count
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == +want
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(places) == list(range(len(places)))
    for own in places.values():
        ends = [0] + [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
