"""Spelling variants, benchmark decontamination and the Merkle manifest against brute-force versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rowsmith.llm import decontaminate, manifest, variants
from rowsmith.operators import shared


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- spelling variants ---------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = defaultdict(set)
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = Counter()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[(w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)] += 1
    return out


@pytest.fixture(scope="module")
def spelled_rows(odd_rows):
    rng = random.Random(11)
    letters = "abcdeé×ÿßÀ"
    rows = list(odd_rows)
    stems = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(40)]
    for k, stem in enumerate(stems):
        rows.append((1000 + k, " ".join([stem] * rng.choice([1, 2, 30, 400])), "s1"))
        for j in range(6):
            at, other = rng.randrange(len(stem)), rng.choice(letters)
            edit = rng.choice([stem[:at] + stem[at + 1 :], stem[:at] + other + stem[at + 1 :], stem[:at] + other + stem[at:]])
            rows.append((2000 + 10 * k + j, f"{edit.upper() if j == 3 and edit.isascii() else edit},{edit}; " * rng.choice([1, 2, 30]), "s0"))
    long = "ab" * 3000
    rows += [(5000, f"{long} {long} {long}c {long}c {long[:-1]}z {long[:-1]}z", "s2"), (5001, long + " " + long[::-1] + " " + long[::-1], None)]
    rows += [(5500, "chainword " * 900 + "chaimword " * 60 + "chaimmord " * 4, "s1")]
    rows += [(6000 + k, "anagram managra gramana " * 2, "s1") for k in range(4)]
    return rows


@pytest.mark.parametrize("piece", [1024, 2])
def test_variants(make, spelled_rows, monkeypatch, piece):
    monkeypatch.setattr(variants, "PIECE_WORDS", piece)
    want = brute_variants(spelled_rows)
    assert sum(1 for row in want if row[1] is not None) > 20 and any(row[2] not in (row[0], row[1]) for row in want)
    got = variants.variants(make(spelled_rows)).select("word", "form", "root", "n", "n_near", "form_n")
    assert rows_of(got) == want


def test_variants_of_nothing(make, nothing):
    assert variants.variants(nothing).count() == 0
    assert variants.variants(make([(1, None, None), (2, "", "s"), (3, "short words only", "s")])).count() == 0


def test_no_table_of_words_is_broadcast_by_its_file_size(make, spark, spelled_rows, monkeypatch):
    """A file below the threshold holds ten times as much in memory, and the pieces that visit dozens of stations far more."""
    planned, write = [], variants.written

    def watched(df):
        planned.append(df)
        return write(df)

    monkeypatch.setattr(variants, "written", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        planned.append(variants.variants(make(spelled_rows)))
        plans = [df._jdf.queryExecution().sparkPlan().toString() for df in planned]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for plan in plans for line in plan.splitlines() if re.search(r"Join \[(station|root|word)#", line)]
    assert all(any(f"[{key}#" in line for line in joins) for key in ("station", "root", "word"))
    assert all("SortMergeJoin" in line for line in joins), joins


def test_every_near_pair_of_blocks_is_found():
    rng = np.random.default_rng(5)
    x = variants.LETTERS[3] + rng.integers(0, 3, (300, 8)).astype(np.uint8)
    x = np.unique(x, axis=0)
    i, j = variants.near_in_blocks(x, None)
    differing = (x[:, None, :] != x[None, :, :]).sum(axis=2)
    assert set(zip(i, j)) == {(a, b) for a, b in np.argwhere(differing == 1) if a < b}


@pytest.mark.parametrize("classes", [2, 5, 7])
def test_blocks_of_near_words_are_neighbours_once(spark, classes):
    words = [("abcdefgh", 2), ("abcdefgi", 2), ("abcdefghi", 2), ("bbcdefgh", 2), ("abcdefg", 2)]
    found = variants.blocks(spark.createDataFrame(words, "word string, n long"), classes)
    visits = found.selectExpr("word", "block", f"{variants.neighbours(classes)} AS station").collect()
    blocks = {r["word"]: tuple(r["block"]) for r in visits}
    for a, b in itertools.combinations(blocks, 2):
        meets = sum((r["word"], tuple(r["station"])) in ((a, blocks[b]), (b, blocks[a])) for r in visits)
        if one_edit(a, b):
            assert meets == (2 if blocks[a] == blocks[b] else 1)


# --- benchmark decontamination --------------------------------------------------


PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_contaminated(rows, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = PLAIN.findall(lowered(text))
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[s : s + window])].add("" if item is None else str(item))
    out = Counter()
    for i, text, _ in rows:
        w = PLAIN.findall(lowered(text))
        hit, named = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    named |= windows[tuple(w[s : s + n])]
        listed = ",".join(sorted(named))
        out[(i, len(w), len(hit), len(named), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.fixture(scope="module")
def leaks(odd_rows):
    rng = random.Random(17)
    vocabulary = ["la", "le", "tha", "on", "er", "ÉT", "x1", "ön"]
    items = [(k, " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 11, 40])))) for k in range(40)]
    items += [(100, None), (101, ""), (102, "?!"), (None, items[3][1]), (3, items[7][1]), (103, items[20][1]), (104, "Alpha, BETA"), (104, "one")]
    items += [(105, "same " * 25), (106, "common passage " + items[9][1])]
    rows = list(odd_rows)
    for k in range(60):
        text = rng.choice(items)[1] or ""
        words = text.split(" ")
        cut = rng.randrange(len(words))
        noise = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))
        rows.append((3000 + k, rng.choice([f"{noise} {text}", f"{text.upper()}\n{noise}", " ".join(words[cut:]), f"{text}, {text} {noise} {text}"]), "s1"))
    rows += [(4000, "same " * 60, "s0"), (4000, "same " * 60, "s0"), (4000, "other", "s0"), (4001, "same " * 9, "s0"), (4002, "Kelvin İ É", "s0")]
    rows += [(5000 + k, items[9][1] + " and " + items[30][1], "hot") for k in range(50)]
    return rows, items


def bench(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, n_words int, row string")


@pytest.mark.parametrize("limit", [shared.BROADCAST_BYTES, 0])
def test_contaminated(spark, make, leaks, monkeypatch, limit):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
    rows, items = leaks
    got = decontaminate.report(make(rows), bench(spark, items))
    want = brute_contaminated(rows, items)
    assert sum(n for row, n in want.items() if row[5]) > 60
    assert rows_of(got) == want


def test_spans_of_hit_words(spark, make):
    text = " ".join(f"w{k}" for k in range(30))
    found = decontaminate.contaminated(make([(1, f"a b {text} c {text[:60]}", "s")]), bench(spark, [(7, text), (8, "c")])).first()
    assert [tuple(s) for s in found["spans"]] == [(2, 49)] and found["items"] == ["7", "8"]
    found = decontaminate.contaminated(make([(1, f"{text} zz zz {text}", "s")]), bench(spark, [(7, text)]), window=13, width=4).first()
    assert [tuple(s) for s in found["spans"]] == [(0, 29), (32, 61)]


def test_contaminated_of_nothing(spark, make, nothing):
    some = [(1, "a b c", "s")]
    assert decontaminate.report(nothing, bench(spark, [(1, "a")])).count() == 0
    assert rows_of(decontaminate.report(make(some), bench(spark, []))) == brute_contaminated(some, [])


# --- Merkle manifest --------------------------------------------------------------


def digest(*values):
    return hashlib.sha256(
        "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()
    ).hexdigest()


def tree(ground):
    levels = [ground]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 3 * 3
        out.append((level[start:i], level[i + 1 : start + 3]))
        i //= 3
    return out


def brute_manifest(rows):
    sources = defaultdict(list)
    for i, text, source in rows:
        n = len(text) if text is not None else None
        leaf = digest(i, source, "en", n, text)
        forged = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        other = digest(i, source, "en", n, text.replace("\n", "") if text is not None else None) if forged else leaf
        sources[source].append(((i is not None, i or 0, leaf), i, leaf, other))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, _, leaf, _ in sorted(sources[s], key=lambda x: x[0])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = Counter()
    for place, s in enumerate(order):
        for at, (_, i, leaf, other) in enumerate(sorted(sources[s], key=lambda x: x[0])):
            path = way(trees[s], at) + way(top, place)
            reached = other
            for before, after in path:
                reached = digest(*before, reached, *after)
            proof = digest(*[d for before, after in path for d in before + after])
            out[(i, leaf, trees[s][-1][0], top[-1][0], proof, reached, reached == top[-1][0])] += 1
    return out


@pytest.mark.parametrize(("levels", "leaves"), [(6, 8192), (1, 4), (2, 30)])
def test_manifest(make, odd_rows, monkeypatch, levels, leaves):
    monkeypatch.setattr(manifest, "CHUNK_LEVELS", levels)
    monkeypatch.setattr(manifest, "PARTITION_LEAVES", leaves)
    rng = random.Random(23)
    rows = list(odd_rows) + [(7000 + k, f"line\n{k}" if k % 3 else str(k), rng.choice(["hot", "hot", "", f"n{k % 37}", "é"])) for k in range(300)]
    rows += [(7001, "again", "hot")] * 40
    rng.shuffle(rows)
    want = brute_manifest(rows)
    assert {row[6] for row in want} == {True, False}
    assert rows_of(manifest.prove(make(rows))) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 28])
def test_manifest_of_few(make, n):
    rows = [(k, f"t{k}\n", None) for k in range(n)]
    assert rows_of(manifest.prove(make(rows))) == brute_manifest(rows)


def test_proofs_lead_to_the_root(make, odd_rows):
    for row in manifest.prove(make(odd_rows), proofs=True).collect():
        path = [([bytes.fromhex(d) for d in p["before"]], [bytes.fromhex(d) for d in p["after"]]) for p in row["proof"]]
        assert manifest.folded(bytes.fromhex(row["leaf"]), path).hex() == row["root"]


def test_octopus_is_the_least_set_of_further_nodes():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randrange(1, 90)
        known = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        levels = tree([str(k) for k in range(n)])
        given = {(level, int(i)) for level, lacks in manifest.missing_upwards(np.array(known), n, 0) for i in lacks}
        # Nodes that are known or derived are never fetched, and every derived node has its whole family.
        have = {(0, k) for k in known}
        for level in range(len(levels) - 1):
            families = {i // 3 for at, i in have if at == level}
            for p in families:
                family = {(level, i) for i in range(3 * p, min(3 * p + 3, len(levels[level])))}
                assert family <= have | given and family & have
                have.add((level + 1, p))
        assert not have & given and {at for at, _ in given} <= set(range(len(levels) - 1))


def test_nodes_and_proofs_digest_plain_hexadecimal_texts(make):
    """The contract gives lengths to the fields of a leaf only; digests enter as their 64 characters."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    rows = [(k, "a\nb", "s") for k in range(2, 6)] + [(6, "é", None), (7, "", "t")]
    leaf = [h(f"1:{k}", "1:s", "2:en", "1:3", "3:a\nb") for k in range(2, 6)] + [h("1:6", "-", "2:en", "1:1", "2:é"), h("1:7", "1:t", "2:en", "1:0", "0:")]
    low = [h(*leaf[:3]), h(leaf[3])]
    s = h(*low)
    root = h(leaf[4], s, leaf[5])  # null first; a lone leaf is its subroot
    siblings = [[leaf[1], leaf[2], low[1]], [leaf[0], leaf[2], low[1]], [leaf[0], leaf[1], low[1]], [low[0]], [s, leaf[5]], [leaf[4], s]]
    got = {r["doc_id"] - 2: r for r in manifest.prove(make(rows)).collect()}
    for k, beside in enumerate(siblings):
        assert (got[k]["leaf"], got[k]["subroot"], got[k]["root"]) == (leaf[k], s if k < 4 else leaf[k], root)
        assert got[k]["proof_sha256"] == h(*beside, *([leaf[4], leaf[5]] if k < 4 else []))
    # Of 2 to 7, crc32 is even for 4 and 5 (of this source) alone among those with line breaks.
    assert {k + 2 for k in got if not got[k]["verified"]} == {k for k in range(2, 6) if zlib.crc32(str(k).encode()) % 2 == 0} == {4, 5}
    changed = [h(f"1:{k}", "1:s", "2:en", "1:3", "2:ab") for k in (4, 5)]
    assert got[2]["folded_root"] == h(leaf[4], h(h(leaf[0], leaf[1], changed[0]), low[1]), leaf[5])
    assert got[3]["folded_root"] == h(leaf[4], h(low[0], h(changed[1])), leaf[5])
    assert got[0]["folded_root"] == root
