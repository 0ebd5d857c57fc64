import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from langmix.llm.encode import encode_counts, load, tokenizer_path
from langmix.llm.mixing import find_exponent, mix, mixing_plan, with_tokens, word_count
from tests.llm import data


def shares(plan):
    return {r.source: r for r in plan.collect()}


def corpus(spark, sizes):
    rows = [(k * 10_000 + i, "w " * (3 + i % 5), f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_entropy_target(spark):
    plan = shares(mixing_plan(corpus(spark, [600, 60, 20, 5]), word_count(F.col("text")), target_entropy=0.8, max_epochs=None))
    h = -sum(r.weight * math.log(r.weight) for r in plan.values())
    assert abs(h / math.log(4) - 0.8) < 1e-6
    assert abs(sum(r.weight for r in plan.values()) - 1) < 1e-9


def test_repetition_limit_binds(spark):
    plan = shares(mixing_plan(corpus(spark, [600, 60, 20, 5]), word_count(F.col("text")), target_entropy=1.0, max_epochs=3.0))
    assert abs(max(r.epochs for r in plan.values()) - 3) < 0.05 and abs(min(r.epochs for r in plan.values()) - 1) < 0.01


def test_budget_realised(spark):
    docs = corpus(spark, [600, 60, 20, 5])
    for budget in (None, 1_000, 9_000):
        plan = shares(mixing_plan(docs, word_count(F.col("text")), budget=budget))
        got = defaultdict(int)
        seen = defaultdict(Counter)
        for r in mix(docs, budget=budget, block_tokens=50).collect():
            got[r.source] += r.mix_tokens
            seen[r.source][r.doc_id] += 1
            assert r.mix_epoch < math.ceil(plan[r.source].epochs - 1e-9)
        for s, r in plan.items():
            assert 0 <= got[s] - r.budget < 8  # the document that crosses the budget is whole
            times = set(seen[s].values())
            assert max(times) - (min(times) if len(seen[s]) == r.docs else 0) <= 1
        if budget is None:
            assert all(len(seen[s]) == r.docs for s, r in plan.items())


def test_epochs_are_different_permutations(spark):
    docs = corpus(spark, [400, 40])
    got = mix(docs, target_entropy=1.0, max_epochs=4.0, block_tokens=20).where("source = 's1'").collect()
    by = {e: {r.doc_id: r.mix_block for r in got if r.mix_epoch == e} for e in (0, 1)}
    assert by[0] != by[1] and by[0].keys() == by[1].keys()


def test_awkward_rows(spark):
    docs = data.table(spark)
    got = mix(docs).collect()
    assert {(r.doc_id, r.text) for r in got} == {(r[0], r[1]) for r in data.awkward()}
    assert {r.mix_tokens for r in got if r.doc_id == 200} == {0}
    assert mix(data.table(spark, [])).collect() == []
    none = data.table(spark, [r for r in data.awkward() if not (r[1] or "").strip()])
    assert mix(none).count() == none.count()


def test_one_source(spark):
    assert mix(corpus(spark, [30])).count() == 30


def test_exponent_bounds(spark):
    p = spark.createDataFrame([(0.5,), (0.25,), (0.25,)], "p double")
    assert find_exponent(p, 0.1, None, None) > 1 - 1e-6  # already flatter than asked
    assert find_exponent(p, 1.0, None, None) < 1e-3


def test_tokens_are_the_encoders(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = data.awkward()
    got = with_tokens(data.table(spark, rows), path).select("doc_id", "text", "n_tokens").collect()
    want = encode_counts(load(path), [r[1] or "" for r in rows])
    assert Counter(tuple(r) for r in got) == Counter((r[0], r[1], int(n)) for r, n in zip(rows, want))


def test_registered_query_and_stage_weigh_by_encoder_tokens(spark, tmp_dir):
    import __spark_entry__ as E
    import corpus_pipeline

    rows = [(i, "\u4e2d\u6587\u6ca1\u6709\u7a7a\u683c" * 40, "zh", "unspaced", 240) for i in range(20)]
    rows += [(100 + i, "plain words with blanks " * 40, "en", "spaced", 960) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    tokens = {s: int(encode_counts(load(tokenizer_path("byte_bpe_50k.json")), [t])[0]) for _, t, _, s, _ in rows}
    assert tokens["unspaced"] > 100
    got = E.queries()["op7_mixing"](spark, tmp_dir).collect()
    assert {(r.source, r.mix_tokens) for r in got} == set(tokens.items())
    mixed = Counter(r.source for r in corpus_pipeline.mixed(spark, docs, tmp_dir).collect())
    assert max(mixed.values()) < 40  # by words, the texts without blanks would be read twice


def test_stage_stores_the_order_of_the_mix(spark, tmp_dir):
    import corpus_pipeline

    rows = [(k * 10_000 + i, f"words of text {k} {i}", "en", f"s{k}", 20) for k, n in enumerate([900, 60]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mixed(spark, docs, tmp_dir).write.parquet(f"{tmp_dir}/mixed")
    back = spark.read.parquet(f"{tmp_dir}/mixed").select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    stored_ids = [r.doc_id for r in sorted(back, key=lambda r: (r.file_name, r.row_index))]
    at = defaultdict(list)
    for i, d in enumerate(stored_ids):
        at[d].append(i)
    twice = [v for v in at.values() if len(v) == 2]
    assert len(twice) >= 50 and len(at) == 960
    assert min(v[1] for v in twice) > max(v[0] for v in at.values())  # all of the first epoch comes first
    first = stored_ids[:960]
    assert first != sorted(first) and [d for d in first if d < 10_000][:20] != list(range(20))
    small = [i for i, d in enumerate(first) if d >= 10_000]
    assert max(small) - min(small) > 400  # sources are mingled
