import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspan.llm import golden_mix

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_stop_at_the_cap():
    plan = {s: (n, t) for s, n, t in golden_mix.shares([("b", 10), ("a", 10), (None, 100), ("c", 1000), ("z", 0)])}
    assert plan["a"][1] == 30 and plan["b"][1] == 30  # capped at 3 times their sizes
    assert abs(sum(t for _, t in plan.values()) - 1120) < 1e-9
    assert plan["z"] == (0, 0.0)
    assert abs(plan["c"][1] / plan[None][1] - 1 / 2) < 1e-9 or plan[None][1] == 300


def test_mix(spark, docs, none):
    rows = golden_mix.mix(docs, min_slots=400).collect()
    assert len(rows) == docs.count()
    text = defaultdict(list)
    for r in docs.collect():
        text[r["doc_id"]].append(words(r["text"]))
    took, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r["size"] in text[r["doc_id"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["target"] <= 3 * r["source_size"] + 1e-6
    for s, t in target.items():
        assert abs(took[s] - t) <= 0.02 * sum(size.values()) / 4
    assert {r["source_size"] for r in rows} == set(size.values())
    again = golden_mix.mix(docs.repartition(5), min_slots=400).collect()
    pick = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert pick(rows) == pick(again)
    assert golden_mix.mix(none).count() == golden_mix.mixed(none).count() == 0


def test_schedule_is_even(spark):
    plan = [("a", 1, 5.0), ("b", 1, 2.0), ("c", 1, 1.0)]
    slots = golden_mix.schedule(plan, spark, 1, 8000).collect()
    for stop in (80, 800, 8000):
        n = defaultdict(int)
        for r in slots:
            if r["id"] < stop:
                n[r["source_no"]] += 1
        for k, share in enumerate((5 / 8, 2 / 8, 1 / 8)):
            assert abs(n[k] - share * stop) <= 6


@pytest.mark.parametrize("min_slots", [golden_mix.SLOTS, 300])
def test_blocks_are_joined_in_the_order_of_the_schedule(spark, docs, min_slots):
    """The blocks hold the words that ``mix`` counts, are equal to within a word, and keep to the shares all the way."""
    got = golden_mix.scheduled(docs, min_slots=min_slots).orderBy("slot").collect()
    rows = golden_mix.mix(docs, min_slots=min_slots).collect()
    assert sum(r["n_words"] for r in got) == sum(r["taken"] for r in rows)
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    target = {r["source"]: r["target"] for r in rows}
    sizes, took, seen = defaultdict(set), defaultdict(int), 0
    total = sum(target.values())
    for r in got:
        assert words(r["text"]) == r["n_words"]
        s = sources[r["source_no"]]
        sizes[s].add(r["n_words"])
        took[s] += r["n_words"]
        seen += r["n_words"]
        if seen > total / 4:  # low discrepancy: at any point of the mix
            for x in sources:
                assert abs(took[x] - seen * target[x] / total) <= 0.02 * total + 2 * max(sizes[x] or {0})
    for s, n in ((s, n) for s, n in sizes.items() if n):
        assert max(n) - min(n) <= 1
        assert abs(took[s] - target[s]) <= max(2 * max(n), 0.01 * target[s])
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    some = next(r for r in got if len(r["doc_ids"]) == 1 and r["n_words"] > 0)
    assert f" {some['text']} " in " " + " ".join(re.findall(r"[^\x20\x09-\x0D]+", text[some["doc_ids"][0]])) + " "


def test_mixed_repeats_rows(spark, docs):
    took = golden_mix.mix(docs)
    out = golden_mix.mixed(docs)
    assert out.columns == docs.columns
    expected = took.where("taken > 0").agg(F.sum(F.expr("(2 * taken + size) div (2 * size)"))).first()[0]
    assert out.count() == expected


def test_pipeline_is_its_stages(spark, docs, tmp_path):
    path = str(tmp_path / "sf")
    docs.write.parquet(f"{path}/documents.parquet")
    step, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, path)
        seen.append(step.count())
        if name != "bpe":
            assert step.columns == docs.columns
            step.write.parquet(f"{path}/{name}.parquet")
            step = spark.read.parquet(f"{path}/{name}.parquet")
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, step.collect()))
    assert seen[0] <= docs.count() and seen[1] == seen[0] and seen[2] <= seen[1] and seen[4] == seen[3]


def test_small_sources_meet_their_targets(spark):
    rows = [(i, "w " * 1000, "z") for i in range(400)] + [(1000 + i, "w " * 20, "m") for i in range(3)] + [(2000, "a b c d e f g", "t")]
    got = golden_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_slots=50).collect()
    took, target = defaultdict(int), {}
    for r in got:
        took[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target["m"] == 180 and target["t"] == 21  # far below the words of a slot: 400067 / 50
    for s, t in target.items():
        assert abs(took[s] - t) <= max(1, 0.005 * t)


def test_pipeline_by_hand(spark, docs, tmp_path, monkeypatch):
    """All five stages against versions that compare every row with every other, or go by the definitions."""
    import hashlib
    from collections import Counter

    duckdb, tokenizers = pytest.importorskip("duckdb"), pytest.importorskip("tokenizers")
    import numpy as np
    from test_pairs import components, key, lines_by_hand, shingles
    from test_quality import by_hand

    from loomspan.llm import kneser_ney
    from loomspan.llm.wordtable import default_vocabulary

    monkeypatch.setattr(kneser_ney, "MIN_DOCS", 10)
    rows = [r.asDict() for r in docs.collect()]
    # quality: basic rules, then bits under the model of the language, within its band
    kept = []
    for lang in {r["lang"] for r in rows}:
        mine = [r for r in rows if r["lang"] == lang and r["text"]]
        letters = Counter(c for r in mine for c in kneser_ney.folded()[kneser_ney.code_points([r["text"]])].tolist() if c < 1 << 16)
        table = kneser_ney.classes(tuple(sorted(sorted(letters, key=lambda c: (-letters[c], c))[: kneser_ney.LETTERS])))
        codes = [kneser_ney.grams([r["text"]], table)[0] for r in mine]
        if not mine:
            continue
        model = kneser_ney.Model(*kneser_ney.fit(*np.unique(np.concatenate(codes), return_counts=True)))
        bits = [-model.log2(c).mean() for c in codes]
        good = [(r, b) for r, b in zip(mine, bits) if (n := by_hand(r["text"]))[0] >= 50 and 100 * n[4] <= 50 * n[0]]
        if len(good) >= 10:
            b = np.sort([b for _, b in good])
            mid = b[(len(b) - 1) // 2]
            spread = kneser_ney.WIDTH * max(kneser_ney.FLOOR, 1.4826 * np.sort(abs(b - mid))[(len(b) - 1) // 2])
            good = [(r, b) for r, b in good if mid - spread - 1e-9 <= b <= mid + spread + 1e-9]
        kept += [r for r, _ in good]
    assert 20 < len(kept) < len(rows)
    # lines
    text = lines_by_hand(kept)
    for r in kept:
        r["text"] = text[r["doc_id"], r["text"]]
    # near copies: one row for each id and text, one of them for each class
    once = list({(r["doc_id"], r["text"]): r for r in kept}.values())
    sets = [shingles(r["text"]) for r in once]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components(len(once), links)
    stay = [min((r for i, r in enumerate(once) if root[i] == k and sets[i]), key=key) for k in {root[i] for i in range(len(once)) if sets[i]}]
    stay += [r for r, s in zip(kept, map(lambda r: shingles(r["text"]), kept)) if not s]
    # mix, by its SQL
    spark.createDataFrame(stay, docs.schema).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    times = Counter()
    for r in db.sql(golden_mix.ORACLE).df().itertuples():
        if r.size:
            times[None if r.doc_id != r.doc_id else int(r.doc_id)] += (2 * r.taken + r.size) // (2 * r.size)
    # tokens
    lib = tokenizers.Tokenizer.from_file(default_vocabulary())
    expected = []
    for r in stay:
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        expected += [(str(r["doc_id"]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * times[r["doc_id"]]
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()]
    assert sorted(got) == sorted(expected) and len(got) > 20


def test_thousands_of_sources(spark):
    """Every source of thousands comes near its target; a third of all rows is of one of them."""
    n = 2000
    df = spark.range(3 * n).selectExpr("id as doc_id", f"if(id % 3 = 0, 's', concat('s', id % {n})) as source", "repeat('word ', int(1 + id % 40)) as text")
    got = golden_mix.mix(df).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert len(by) > 1000 and ((by["taken"] - by["target"]).abs() <= 1 + 0.02 * by["target"]).all()
    assert (got["taken"] <= 3 * got["size"]).all() and abs(by["target"].sum() - by["size"].sum()) < 1
