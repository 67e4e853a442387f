from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import chosen_path, common, license_scan, line_runs, projection_forest


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_linked_groups(spark):
    r = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in r.integers(0, 120, (90, 2))] + [(200 + k, 201 + k) for k in range(40)] + [(300, 300 + k) for k in range(60)]
    got = {x["node"]: x["component"] for x in common.linked_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = components(400, links)
    assert all(got.get(x, x) == expected[x] for x in range(400))
    assert common.linked_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_groups_run_to_the_end(spark):
    """A chain of stars that takes many rounds: they go on until nothing changes."""
    links = [(1000 - k, 999 - k) for k in range(500)] + [(1000 - k, 5000 + 10 * k + j) for k in range(0, 500, 50) for j in range(10)]
    got = {x["component"] for x in common.linked_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {500}


def test_long_texts_are_sliced_by_bytes():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["x" * 3_000_000, None, "y", "z" * 900_000, "w" * 900_000])], names=["text"])
    parts = list(common.slices(batch, 1.0))
    assert [p.num_rows for p in parts] == [1, 3, 1] and pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert list(common.slices(batch.slice(0, 0))) == []


def test_running_total(spark):
    rows = [(g, i, i * 3 % 7) for g in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v long")
    got = {(r["g"], r["i"]): r["before"] for r in common.running_total(df, ["g"], ["i"], "v", "before", F.expr("i div 8")).collect()}
    assert got == {(g, i): sum(j * 3 % 7 for j in range(i)) for g in ("a", None) for i in range(50)}


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def key(r):
    return r["doc_id"] is None, r["doc_id"] or 0


def test_join_matches_brute_force(spark, docs, none):
    source = docs.collect()
    sets = [shingles(r["text"]) for r in source]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    root = components(len(sets), links)
    first = defaultdict(list)
    for i, r in enumerate(source):
        first[root[i]].append(key(r))
    expected = sorted((key(r), count[i], min(first[root[i]])) for i, r in enumerate(source))
    got = chosen_path.join(docs).collect()
    assert sorted((key(r), r["n_links"], (r["class_id"] is None, r["class_id"] or 0)) for r in got) == expected
    kept = chosen_path.deduplicated(docs)
    assert kept.columns == docs.columns
    empty = sum(not s for s in sets)
    assert kept.count() == len({root[i] for i, s in enumerate(sets) if s}) + empty
    assert chosen_path.join(none).count() == chosen_path.deduplicated(none).count() == 0


def test_large_nodes_and_clusters_are_split(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    r = np.random.default_rng(6)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(40):
        words = list(base)
        words[int(r.integers(0, 200))] = f"other{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"x{int(k)}" for k in r.integers(0, 5000, 120))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    near = {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    classes = chosen_path.described(df).select(F.col("f1").alias("c"), "n", "tokens")
    # small nodes of two: the recursion has to split, or to take dense nodes as they are
    links = chosen_path.candidates(classes, small=2, depth=4)
    grouped = common.linked_groups(links)
    assert grouped.groupBy("component").count().agg(F.max("count")).first()[0] >= 40
    assert {x["doc_id"]: x["n_links"] for x in chosen_path.join(df).collect()} == near


def test_runs_meet_the_recall():
    """Pairs whose tokens agree by chance, led down the same nodes as ``_children`` samples them."""
    runs, depth, branch = chosen_path.runs_needed(), chosen_path.DEPTH, chosen_path.BRANCH
    r = np.random.default_rng(8)
    miss, pairs = 0, 20_000
    same = r.random((pairs, chosen_path.TOKENS)) < 0.8
    for s in same:
        met = False
        for _ in range(runs if s.sum() >= chosen_path.least_tokens(0.8) else 0):
            alive = 1
            for _ in range(depth):
                # so few nodes suffice: once many are alive, a pair doesn't die out
                alive = sum(int(s[r.choice(chosen_path.TOKENS, branch, replace=False)].sum()) for _ in range(min(alive, 8)))
            met = met or alive > 0
            if met:
                break
        miss += not met
    assert miss / pairs <= 1 - chosen_path.RECALL + 3 * ((1 - chosen_path.RECALL) / pairs) ** 0.5
    assert abs(chosen_path.missed(1, depth=1) - 0.2**2) < 0.003


def test_sets_that_share_half_a_hash_stay_apart(spark, monkeypatch):
    """Classes are told apart by 128 bits: equal first halves must not join different sets."""
    rows = [(i, " ".join(f"{i}w{k}" for k in range(30))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = chosen_path.described
    monkeypatch.setattr(chosen_path, "described", lambda *a, **k: real(*a, **k).withColumn("f1", F.lit(5).cast("long")))
    got = chosen_path.join(df).collect()
    assert len(got) == 6 and all(r["n_links"] == 0 and r["kept"] for r in got)


def test_blocks_of_many_sizes(spark, monkeypatch):
    """Clusters of several blocks, with sets from a few to many shingles and repeated rows."""
    monkeypatch.setattr(chosen_path, "SHINGLES", 300)
    r = np.random.default_rng(16)
    rows = []
    for i in range(50):
        n = int(80 * 1.04**i)
        rows.append((i, " ".join(f"w{k}" for k in range(n))))
    rows += [(200, rows[3][1]), (200, rows[3][1]), (None, rows[20][1])]
    df = spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], "doc_id long, text string")
    sets = [shingles(t) for _, t in rows]
    near = defaultdict(int)
    for i in range(len(rows)):
        near[rows[i]] += sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(len(rows)))
    got = chosen_path.join(df).collect()
    total = defaultdict(int)
    for x in got:
        total[x["doc_id"]] += x["n_links"]
    assert total == {d: sum(v for (e, _), v in near.items() if e == d) for d, _ in rows}
    assert {x["class_id"] for x in got} == {0}


def vectors(spark):
    r = np.random.default_rng(9)
    rows = []
    for c in range(60):
        center = r.standard_normal(32)
        for _ in range(int(r.integers(1, 8))):
            rows.append((center + 0.2 * r.standard_normal(32)).astype(np.float32).tolist())
    dense = r.standard_normal(32)
    rows += [(dense + 0.05 * r.standard_normal(32)).astype(np.float32).tolist() for _ in range(40)]
    rows += [rows[0], rows[0], [2.0 * x for x in rows[1]], None, [], [0.0] * 32, [float("nan")] * 32, [1.0] * 31 + [float("inf")], [None] * 32, [1.0, 2.0], [1.0, 2.0], [1e-30] * 32]
    data = [(i, v, 0) for i, v in enumerate(rows)] + [(None, rows[0], 1)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3), data


@pytest.mark.parametrize(("leaf", "bucket"), [(16, 64), (64, 8), (16, 1 << 16)])
def test_forest_matches_brute_force(spark, monkeypatch, leaf, bucket):
    monkeypatch.setattr(projection_forest, "SIDE", 16)
    df, data = vectors(spark)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in data]
    links = []
    for i, (_, a, _) in enumerate(data):
        for j in range(i):
            b = data[j][1]
            if ok[i] and ok[j] and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                    links.append((i, j))
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = components(len(data), links)
    got = {r["vec_id"]: r for r in projection_forest.link(df, leaf=leaf, bucket=bucket).collect()}
    assert len(got) == len(data)
    found = sum(got[i]["n_links"] for i, _, _ in data)
    assert 0.99 * 2 * len(links) <= found <= 2 * len(links)
    if found == 2 * len(links):
        for k, (i, _, _) in enumerate(data):
            assert got[i]["n_links"] == n[k]
            assert got[i]["component_id"] == (data[root[k]][0] if ok[k] or i is not None else None)
            assert got[i]["kept"] == (i == got[i]["component_id"])


def test_small_samples_are_split_on(spark, monkeypatch):
    monkeypatch.setattr(projection_forest, "SAMPLE", 24)
    df, data = vectors(spark)
    few = projection_forest.fit(projection_forest.unit(np.random.default_rng(1).standard_normal((24, 32))), 3000, 2, 16)
    assert few[0].extra >= 4 and few[0].leaves == few[0].count << few[0].extra
    got = sum(r["n_links"] for r in projection_forest.link(df, leaf=4, bucket=16).collect())
    monkeypatch.undo()
    full = sum(r["n_links"] for r in projection_forest.link(df, leaf=500).collect())
    assert 0.95 * full <= got <= full


def test_dense_nodes_are_leaves(spark):
    """A large group within the overlap isn't copied to leaf after leaf, and is compared in full."""
    r = np.random.default_rng(12)
    center = r.standard_normal(32)
    x = np.concatenate([center + 0.01 * r.standard_normal((1500, 32)), r.standard_normal((500, 32))]).astype(np.float32)
    tree = projection_forest.fit(projection_forest.unit(x), len(x), 1, 16)[0]
    row, _ = tree.route(projection_forest.unit(x))
    assert len(row) < 12 * len(x)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, c string")
    got = projection_forest.link(rows, leaf=16, bucket=400)
    assert got.where("n_links = 1499").count() == 1500 and got.where("kept").count() == 501


def test_trees_grow_with_the_table():
    few, many = projection_forest.trees_needed(1_000), projection_forest.trees_needed(10**10)
    assert few == projection_forest.TREES < many


def test_forest_of_nothing(spark):
    df, _ = vectors(spark)
    assert projection_forest.link(df.limit(0)).count() == 0


def lines_by_hand(rows, min_words=None):
    """Deleted lines by comparing every run of lines with all that come before it."""
    docs = []
    for d, t in sorted({(r["doc_id"], r["text"]) for r in rows if r["text"]}, key=lambda x: (x[0] is None, x[0] or 0)):
        parts = t.split("\n")
        docs.append((d, t, [(i, p, len(p.encode().split())) for i, p in enumerate(parts) if p.encode().split()]))
    first, gone = {}, defaultdict(set)
    runs = []
    for k, (_, _, lines) in enumerate(docs):
        for i in range(len(lines)):
            for way in (1, -1):
                total, j = 0, i
                while 0 <= j < len(lines):
                    total += lines[j][2]
                    if total >= (min_words or line_runs.MIN_WORDS):
                        a, b = min(i, j), max(i, j)
                        runs.append((k, a, b, tuple(x[1] for x in lines[a : b + 1])))
                        break
                    j += way
    for k, a, _, text in sorted(set(runs), key=lambda r: r[:2]):
        first.setdefault(text, (k, a))
    for k, a, b, text in runs:
        if first[text] != (k, a):
            gone[k].update(x[0] for x in docs[k][2][a : b + 1])
    return {(d, t): "\n".join(p for i, p in enumerate(t.split("\n")) if i not in gone[k]) for k, (d, t, _) in enumerate(docs)}


def test_line_runs_match_brute_force(spark, docs, none):
    source = docs  # of null ids one has a text, and comes last by hand too
    expected = lines_by_hand(source.collect())
    before = source.select("doc_id", "text", *[F.col(c).alias(c) for c in ("lang",)], F.monotonically_increasing_id().alias("nth")).cache()
    got = line_runs.dedup(before).collect()
    text = {r["nth"]: (r["doc_id"], r["text"]) for r in before.collect()}
    changed = 0
    for r in got:
        d, t = text[r["nth"]]
        assert r["text"] == (expected[d, t] if t else t)
        changed += r["_l_n_removed"] > 0
    assert changed > 5
    out = line_runs.dedup(docs)
    assert out.columns == [*docs.columns, "_l_n_lines", "_l_n_removed"] and out.count() == docs.count()
    assert line_runs.dedup(none).count() == 0


@pytest.mark.parametrize("min_words", [1, 7, 20])
def test_shorter_runs(spark, monkeypatch, min_words):
    """Any minimum of words, in pieces of a few lines, with one document of many lines and one line that is everywhere."""
    monkeypatch.setattr(line_runs, "PIECE", 4)
    r = np.random.default_rng(30 + min_words)
    lines = [" ".join(r.choice(list("abcdefghij"), int(r.integers(1, 9)))) for _ in range(25)] + ["", " ", "the common line"]
    rows = [(i, "\n".join(r.choice(lines, int(r.integers(1, 30)), p=[0.03] * 25 + [0.05, 0.05, 0.15]))) for i in range(30)]
    rows += [(50, "\n".join(r.choice(lines, 900))), (51, "the common line\n" * 300), (52, None), (53, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = lines_by_hand([dict(zip(("doc_id", "text"), x)) for x in rows], min_words)
    for x in line_runs.dedup(df, min_words=min_words).collect():
        t = dict(rows)[x["doc_id"]]
        assert x["text"] == (expected[x["doc_id"], t] if t else t)
        assert x["_l_n_lines"] == (0 if t is None else len(t.split("\n")))


def test_line_facts_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, _l_n_lines string, _l_gone int")
    got = line_runs.dedup(df)
    assert got.columns == ["doc_id", "text", "_l_gone", "_l_n_lines", "_l_n_removed"] and got.first()["_l_n_lines"] == 1
    assert line_runs.dedup(df, facts=False).columns == df.columns


def test_licence_scan(spark, docs, none):
    from loomspan.llm.license_templates import TEXTS, whole_texts

    mit = TEXTS["MIT"].replace(". ", ".\n")
    assert license_scan.scan(f"intro words here\nCopyright 2020 someone\n{mit}\nand the end")[0][2] == "MIT"
    assert license_scan.scan("x\nReleased under the MIT License.\ny") == [(1, 1, "MIT", 1.0)]
    assert license_scan.scan("Released under the MIT Licence")[0][3] == 1.0
    assert license_scan.scan("Our tool is fast. Released under the MIT License. See below for more of it.") == [(0, 0, "MIT", 1.0)]
    assert license_scan.scan("first\nand this is Released under\nthe MIT License, as ever") == [(1, 2, "MIT", 1.0)]
    assert license_scan.scan("this is the end of the story and of the day") == []
    assert license_scan.scan(None) == license_scan.scan("") == license_scan.scan("one") == []
    edited = TEXTS["Apache-2.0"].replace("applicable law", "any law").replace("specific language", "exact wording")
    assert [m[2] for m in license_scan.scan(edited)] == ["Apache-2.0"]
    for name, text in whole_texts():  # each is found whole within other words, with some of its own changed
        words = text.split()
        words[50::60] = ["changed"] * len(words[50::60])
        got = license_scan.scan("some words before " + " ".join(words) + " and some after it")
        assert max(got, key=lambda m: m[3])[2] == name and max(m[3] for m in got) > 0.9
    got = license_scan.summary(license_scan.matches(docs.withColumn("text", F.concat("text", F.lit("\nReleased under the MIT License.")))))
    assert got.where("license = 'MIT'").count() == docs.where("text is not null").count()
    assert license_scan.summary(license_scan.matches(none)).count() == 0


def test_repeated_notices_are_linear():
    import time

    began = time.time()
    got = license_scan.scan("Licensed under the MIT License.\n" * 100_000)
    assert len(got) == 100_000 and {m[2:] for m in got} == {("MIT", 1.0)}
    assert time.time() - began < 30


def scan_by_hand(text, pairs, t):
    """Every window of the text against every template."""
    from collections import Counter

    lines = [license_scan.normal(x) for x in text.split("\n")]
    words = [w for ws in lines for w in ws]
    line = [i for i, ws in enumerate(lines) for _ in ws]
    found = []
    for licence, wording in pairs:
        have = license_scan.bigrams(license_scan.normal(wording))
        n = sum(have.values())
        for a in range(len(words)):
            seen, best = Counter(), None
            for b in range(a + 1, len(words)):
                seen[words[b - 1], words[b]] += 1
                dice = 2 * sum((seen & have).values()) / (b - a + n)
                if dice >= t - 1e-12 and (best is None or dice > best[0] + 1e-12):
                    best = dice, a, b
            if best and (words[a], words[a + 1]) in have:
                found.append((-round(best[0] * (best[2] - a + n) / 2), -round(best[0], 12), best[2] - a, a, licence, best[2]))
    out, taken = [], set()
    for _, minus, _, a, licence, b in sorted(found):
        if not taken.intersection(range(a, b + 1)):
            taken.update(range(a, b + 1))
            out.append((a, line[a], line[b], licence, -minus))
    return [x[1:] for x in sorted(out)]


@pytest.mark.parametrize("steps", [40, 3])
def test_scan_matches_brute_force(spark, monkeypatch, steps):
    """With few steps, templates count as long ones."""
    monkeypatch.setattr(license_scan, "STEPS", steps)
    r = np.random.default_rng(21)
    pairs = [(f"l{k:02d}", " ".join(r.choice(list("abcdefgh"), int(r.integers(4, 16))))) for k in range(8)]
    rows = []
    for i in range(60):
        words = list(r.choice(list("abcdefghijkl"), 40))
        for _ in range(2):
            copy = pairs[int(r.integers(0, 8))][1].split()
            if r.random() < 0.6:
                copy[int(r.integers(0, len(copy)))] = "z"
            at = int(r.integers(0, 25))
            words[at : at + len(copy)] = copy
        rows.append((i, "".join(w + ("\n" if r.random() < 0.2 else " ") for w in words)))
    known = license_scan.Templates(pairs, 0.7)
    expected = {i: scan_by_hand(t, pairs, 0.7) for i, t in rows}
    assert sum(map(len, expected.values())) > 40
    for i, t in rows:
        got = license_scan.scan(t, known)
        assert [x[:3] for x in got] == [x[:3] for x in expected[i]] and np.allclose([x[3] for x in got], [x[3] for x in expected[i]])
    if steps == 40:
        df = spark.createDataFrame([*rows, (60, None)], "doc_id long, text string")
        got = {x["doc_id"]: [tuple(m) for m in x["matches"]] for x in license_scan.matches(df, threshold=0.7, pairs=pairs).collect()}
        assert got[60] == [] and all([m[:3] for m in got[i]] == [m[:3] for m in expected[i]] for i, _ in rows)


def test_written_tables_can_be_deleted(spark):
    import os

    df = common.written(spark.range(5).toDF("x"))
    assert df.count() == 5
    path = df.inputFiles()[0].removeprefix("file://")
    since = common.mark()
    other, kept = common.written(spark.range(6).toDF("x")), common.written(spark.range(7).toDF("x"), keep=True)
    common.forget_written(spark, since, (other,))
    assert os.path.exists(path) and other.count() == 6
    common.forget_written(spark)
    assert not os.path.exists(path) and kept.count() == 7
    common.deleted(spark, kept)


def test_whole_licences_are_scanned_in_linear_time():
    """A text of many whole licences takes about as many times as long as one of a few; each is found."""
    import time
    from pathlib import Path

    known = license_scan.default_templates()
    text = (Path(license_scan.__file__).parent / "licences" / "GPL-3.txt").read_text()
    took = []
    for n in (4, 16):
        began = time.process_time()
        found = license_scan.scan("\n".join([text] * n), known)
        took.append(time.process_time() - began)
        assert [f[2:] for f in found] == [("GPL-3", 1.0)] * n
    assert took[1] < 8 * took[0] + 0.5


@pytest.mark.parametrize("seed", range(4))
def test_ends_between_steps_are_found(monkeypatch, seed):
    """Long templates, tried in steps, against every window by hand."""
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    template = r.choice(words, 150).tolist()
    known = license_scan.Templates([("own", " ".join(template))])
    text = r.choice(words, 40).tolist()
    for _ in range(3):
        copy = [w for w in template if r.random() > 0.06] + r.choice(words, int(r.integers(0, 8))).tolist()
        text += copy + r.choice(words, int(r.integers(1, 30))).tolist()
    n, have = known.rows[0][0], known.rows[0][2]
    pairs = list(zip(text, text[1:]))
    at = [k for k, b in enumerate(pairs) if b in have]
    monkeypatch.setattr(license_scan, "STEPS", 10)
    ids = np.array([known.ids[pairs[k]] for k in at])
    dice, begin, end = license_scan.windows(np.array(at), ids, known.of(0)[ids], n, known)
    got = {int(b): (round(float(d), 9), int(e - b)) for d, b, e in zip(dice, begin, end)}
    expected = {}
    for i, b in enumerate(at):
        seen, best = {}, (0.0, 0)
        for j in range(i, len(at)):
            seen[pairs[at[j]]] = seen.get(pairs[at[j]], 0) + 1
            true = at[j] - b + 1
            if true > known.lengths(n)[-1]:
                break
            common = sum(min(v, have[k]) for k, v in seen.items())
            d = 2 * common / (true + n)
            if d >= 0.85 - 1e-12 and d > best[0] + 1e-12:
                best = (d, true)
        if best[1]:
            expected[b] = (round(best[0], 9), best[1])
    assert got == expected and expected


def test_a_recall_out_of_reach_is_an_error():
    assert chosen_path.runs_needed(recall=0.999) >= chosen_path.runs_needed(recall=0.9) >= 1
    for recall in (0.9999, 1.0):
        with pytest.raises(ValueError, match="out of reach"):
            chosen_path.runs_needed(recall=recall)
