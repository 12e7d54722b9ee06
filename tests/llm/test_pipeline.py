"""The pipeline, its stages on odd tables, and the registered queries."""

import os
import pathlib
import random
import subprocess
import sys
from collections import Counter, defaultdict

import compare
import pytest
from test_operators import WORD, brute_near

import __spark_entry__ as entry
import corpus_pipeline
from rowsmith.llm import mixing, queries
from rowsmith.operators.shared import checkpoint_dir

SF_DIR = "/root/testdata/sf0.001"


def text_words(text):
    return WORD.findall(text or "")


def test_stages_keep_the_columns(spark, make, odd_rows, tmp_path):
    docs = make(odd_rows)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_stages_take_an_empty_table(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF_DIR).count() == 0


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    want = sorted(map(tuple, docs.drop("bin_id").collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).drop("bin_id").collect())) == want


def corpus(rng):
    """Documents of twelve sources with a shared line, exact and near copies, junk and short texts."""
    vocabulary = [f"w{k}" for k in range(900)]
    rows = []

    def text(words, line=None):
        cut = sorted(rng.sample(range(1, len(words)), 3))
        lines = [" ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, len(words)])]
        return "\n".join(lines[:2] + ([line] if line else []) + lines[2:])

    for k in range(72):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 260))]
        boiler = "all rights reserved by the owners" if k % 3 == 0 else "a line of few sources" if k % 24 == 1 else None
        rows.append((k, text(words, boiler), f"s{k // 3 % 12}"))
    for k in range(30):
        base = rows[rng.randrange(12)][1].replace("\n", " ").split(" ")
        if k % 2:
            base[rng.randrange(len(base))] = "changed"
        rows.append((100 + k, text(base), rng.choice(["s0", "s5", None])))
    rows += [(200, "too short", "s1"), (201, None, "s2"), (202, "", "s3"), (203, "spam spam spam " * 60, "s4")]
    rows.append((204, " ".join(rng.choice(vocabulary) for _ in range(5000)), "s0"))
    return rows


def test_run_against_plain_python(spark, make, tmp_path):
    """Lines, near copies, the mix's targets and the bins, each judged on what the stage before it kept."""
    rng = random.Random(31)
    sf_dir = str(tmp_path)
    make(corpus(rng)).write.parquet(f"{sf_dir}/documents.parquet")
    # Too few labels to calibrate a forest: the base rules alone decide.
    spark.createDataFrame([(0, 1, 0), (203, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        stages[name] = docs.collect()

    def triples(name):
        return [(r["doc_id"], r["text"], r["source"]) for r in stages[name]]

    def failed(text):
        words = text_words(text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        inside = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
        return len(words) < 50 or 100 * len(inside) > 50 * len(words)

    good = sorted(r for r in corpus(random.Random(31)) if not failed(r[1]))
    assert sorted(triples("quality_rules"), key=lambda r: r[0]) == good and len(good) == 103

    spread = defaultdict(lambda: (set(), []))
    for i, text, source in good:
        for line in text.split("\n"):
            spread[line][0].add(source or "")
            spread[line][1].append(i)
    gone = {line: min(ids) for line, (sites, ids) in spread.items() if text_words(line) and len(sites) >= 10}
    assert set(gone) == {"all rights reserved by the owners"}
    cleaned = [(i, "\n".join(x for x in text.split("\n") if gone.get(x, i) == i), source) for i, text, source in good]
    assert sorted(triples("line_dedup"), key=lambda r: r[0]) == cleaned
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"])

    kept = {i for (i, _, _, keep) in brute_near(cleaned) if keep}
    assert sorted(triples("near_dedup"), key=lambda r: r[0]) == [r for r in cleaned if r[0] in kept] and len(kept) == 73

    before = {i: text_words(text) for i, text, _ in cleaned if i in kept}
    sizes, taken = Counter(), Counter()
    for i, _, source in cleaned:
        sizes[source] += len(before.get(i, ()))
    for i, text, source in triples("source_mix"):
        words = text_words(text)
        taken[source] += len(words)
        assert set(words) <= set(before[i])
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    goal = mixing.targets([sizes[x] for x in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2.0)
    for name, target in zip(names, goal):
        assert abs(taken[name] - target) <= 160, (name, taken[name], target)

    bins, words_in = defaultdict(list), Counter()
    for r in stages["best_fit_packing"]:
        bins[r["bin_id"]].append(r)
        words_in[r["source"]] += r["n_words"]
    assert words_in == taken
    for pieces in bins.values():
        assert sum(r["n_words"] for r in pieces) <= 2048
        assert len({r["source"] for r in pieces}) == len(pieces) == len({r["cluster"] for r in pieces})
    got = sorted((r["doc_id"], r["piece"], r["n_words"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted((r["doc_id"], r["piece"], r["n_words"]) for r in stages["best_fit_packing"])
    # Only the last table is left, and nothing that the stages needed on the way.
    left = [p for p in pathlib.Path(checkpoint_dir(spark).removeprefix("file:")).glob("pipeline-*/*")]
    assert not list(pathlib.Path(checkpoint_dir(spark).removeprefix("file:")).glob("scope-*")) and {p.name for p in left} == {"4-best_fit_packing"}


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, connection, name):
    if name in queries.ORACLES:
        assert compare.difference(spark, SF_DIR, name, queries.QUERIES[name], queries.ORACLES[name], connection) is None
    else:
        assert queries.QUERIES[name](spark, SF_DIR).select("doc_id").distinct().count() == 200


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_the_rest_imports_without_this_package(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    ignore = "llm", "corpus_pipeline.py", ".git", "__pycache__"
    for folder, _, names in os.walk(os.path.join(root, "rowsmith")):
        if not set(ignore) & set(folder.split(os.sep)):
            target = copy / os.path.relpath(folder, root)
            target.mkdir(parents=True, exist_ok=True)
            for n in names:
                (target / n).write_bytes(open(os.path.join(folder, n), "rb").read())
    (copy / "__spark_entry__.py").write_bytes(open(entry.__file__, "rb").read())
    code = "import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op')]; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
