"""Joins on sets and windows against plain brute force."""
import hashlib
import itertools
import random
import re

import pyarrow as pa
import pytest

from cataloom.llm import line_dedup, ngram_join, setjoin
from cataloom.llm.decontaminate import clean_documents, contamination
from cataloom.llm.line_dedup import dedup_lines
from cataloom.llm.ngram_join import keep_first, near_duplicates


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def groups(rows):
    sets = [shingles(r["text"]) for r in rows]
    home = list(range(len(rows)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if similar(sets[i], sets[j]):
            home[find(j)] = find(i)
    out = []
    for i, r in enumerate(rows):
        ids = [x["doc_id"] for k, x in enumerate(rows) if find(k) == find(i) and x["doc_id"] is not None]
        out.append((r["doc_id"], len(sets[i]), min(ids, default=None) if sets[i] else r["doc_id"]))
    return sorted(out, key=repr)


def test_near_duplicates(awkward):
    got = sorted(map(tuple, near_duplicates(awkward).collect()), key=repr)
    assert got == groups(awkward.collect())


def test_chains_of_similar_texts(spark):
    """Each text is similar to the next only, so groups come from links, not from one centre."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[10 * i:10 * i + 100])) for i in range(20)] + [(200 + i, " ".join(f"v{i}_{j}" for j in range(30))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == groups(docs.collect())


def copies_that_link_in_part(n):
    """Near copies of one text of which about one pair in fifty links."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in range(200)]
        for k in rng.sample(range(200), 4):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    return rows


def test_large_group_of_which_few_pairs_link(spark):
    rows = copies_that_link_in_part(300)
    sets = [shingles(t) for _, t in rows]
    linked = sum(similar(a, b) for a, b in itertools.combinations(sets, 2))
    assert 0.01 < linked / (300 * 299 / 2) < 0.1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == groups(docs.collect())
    gone = {j for j in range(300) if any(similar(sets[i], sets[j]) for i in range(j))}
    assert {r["doc_id"] for r in dedup_lines(docs).collect() if r["n_removed"]} == gone


def test_large_group_makes_few_pairs(spark, monkeypatch):
    """Pairs of a group that do not link are dropped by their marks before they are made; no link is lost."""
    made, write = {}, setjoin.materialise

    def counting(df, tag, *more):
        got = write(df, tag, *more)
        made[tag] = max(made.get(tag, 0), got.count())
        return got

    for module in (setjoin, ngram_join, line_dedup):
        monkeypatch.setattr(module, "materialise", counting)
    rows = copies_that_link_in_part(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == groups(docs.collect())
    assert made["tried"] + made["crossing"] < 6_000


@pytest.mark.parametrize("lines", [False, True])
def test_marks_differ_in_no_more_bits_than_sets_in_shingles(lines):
    rule = setjoin.Rule(lines=lines)
    texts = [t for _, t in copies_that_link_in_part(30)] + ["", "a b", None, "one two three four five six"]
    *_, tokens, offset = setjoin.unit_sets(pa.array(texts), rule)
    marks = setjoin.set_marks(tokens, offset, rule.marks).view("<u8")
    sets = [set(tokens[a:b].tolist()) for a, b in itertools.pairwise(offset.tolist())]
    for i, j in itertools.combinations(range(len(sets)), 2):
        apart = sum(int(x).bit_count() for x in (marks[i] ^ marks[j]).tolist())
        assert apart <= len(sets[i] ^ sets[j]) and (len(sets[i] ^ sets[j]) - apart) % 2 == 0


def test_frequent_shingles_in_many_blocks(spark, monkeypatch):
    """Every shingle counts as hot, so the sets that share one lie in different blocks."""
    monkeypatch.setattr(setjoin, "HOT", 1)
    monkeypatch.setattr(setjoin, "BUCKET_ROWS", 10)
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[10 * i:10 * i + 100])) for i in range(12)] + [(200 + i, " ".join(f"v{j}" for j in range(30))) for i in range(40)]
    rows += [(300 + i, " ".join([f"u{i}", *[f"v{j}" for j in range(1, 30)]])) for i in range(3)] + [(400, "alone in its words as no other text has them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == groups(docs.collect())
    gone = expected_lines(docs.collect())
    assert {r["doc_id"]: set(r["removed"]) for r in dedup_lines(docs).collect()} == {i: gone.get(i, set()) for i, _ in rows}


def test_keep_first(awkward, empty):
    """One row of each group stays, by its own doc_id and text; rows without words all stay."""
    rows = awkward.collect()
    kept = keep_first(awkward)
    assert kept.columns == awkward.columns
    got = kept.collect()
    place = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    left = list(range(len(rows)))
    sets = [shingles(r["text"]) for r in rows]
    groups_ = []
    while left:
        group, todo = set(), [left[0]]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += [j for j in left if similar(sets[i], sets[j])]
        left = [i for i in left if i not in group]
        groups_.append(sorted(group))
    worded = [g for g in groups_ if sets[g[0]]]
    assert sum(1 for r in got if shingles(r["text"])) == len(worded)
    assert sum(1 for r in got if not shingles(r["text"])) == sum(1 for s in sets if not s)
    for group in worded:
        stays = [r for r in got if any(r["doc_id"] == rows[i]["doc_id"] and r["text"] == rows[i]["text"] for i in group)]
        assert len(stays) == 1 and place(stays[0]) == min(place(rows[i]) for i in group)
    assert keep_first(empty).count() == 0 and near_duplicates(empty).count() == 0


def test_keep_first_does_not_drop_a_clean_row_with_its_doc_id(spark):
    base = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, base, "a"), (2, base + " x", "b"), (2, other, "c"), (None, base, "d"), (1, base, "e"), (3, None, "f"), (3, None, "g")]
    kept = keep_first(spark.createDataFrame(rows, "doc_id long, text string, tag string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["text"]) == [(1, base), (2, other)] and sum(r["text"] is None for r in kept) == 2


def expected_lines(rows):
    units = [(r["doc_id"] if r["doc_id"] is not None else 1 << 63, i, shingles(x)) for r in rows if r["text"] is not None for i, x in enumerate(r["text"].split("\n"))]
    gone = {}
    index = {}
    for doc, line, s in units:
        for x in s:
            index.setdefault(x, []).append((doc, line, s))
    for doc, line, s in units:
        near = {(d, n) for x in s for d, n, t in index[x] if (d, n) < (doc, line) and similar(s, t)}
        if near:
            gone.setdefault(doc, set()).add(line)
    return gone


def test_dedup_lines(awkward):
    rows = [r for r in awkward.collect()]
    gone = expected_lines(rows)
    for r in dedup_lines(awkward).collect():
        key = r["doc_id"] if r["doc_id"] is not None else 1 << 63
        original = [x["text"] for x in rows if x["doc_id"] == r["doc_id"]]
        if r["text"] is None:
            assert None in original and r["n_lines"] == 0 and r["removed"] == []
            continue
        assert set(r["removed"]) <= gone.get(key, set()) and len(r["removed"]) == r["n_removed"]
        assert any(t is not None and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(key, set())) == r["text"] for t in original)
    assert dedup_lines(awkward).count() == len(rows)


def test_dedup_lines_of_shared_and_null_ids(spark):
    """Rows of one doc_id, or of none, lose their own repeated lines only; each line stays once."""
    line = lambda x: " ".join(f"{x}{i}" for i in range(8))
    rows = [(1, line("a")), (2, "\n".join([line("b"), line("a")])), (2, "\n".join([line("a"), line("c")])), (2, "\n".join([line("d"), line("e")])),
            (None, line("a")), (None, line("f")), (None, line("g")), (None, "\n".join([line("h"), line("g")])), (None, "\n".join([line("i"), line("j")])),
            (None, "\n".join([line("k"), line("l")])), (None, "\n".join([line("k"), line("m")]))]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == len(rows)
    assert sorted(x for r in out for x in r["text"].split("\n") if x) == sorted({x for _, t in rows for x in t.split("\n")})
    assert all(r["n_lines"] - r["n_removed"] == sum(x != "" for x in r["text"].split("\n")) for r in out)


def test_dedup_no_lines(empty):
    out = dedup_lines(empty)
    assert out.count() == 0 and set(empty.columns) < set(out.columns)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, " ".join(f"WORD{i % 97}x{i}" for i in range(20, 45))), (2, "two"), (10, "word9x9 word10x10 word11x11"), (3, None), (4, ""), (5, "never seen here at all by anyone in any of these texts"),
            (11, "word9x9, word10x10; word11x11"), (None, "line 3")]
    return spark.createDataFrame(rows, "item_id long, text string")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def contaminated(rows, items):
    wins = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        wins += [(item, w[i:i + n]) for i in range(len(w) - n + 1)] if w else []
    out = []
    for r in rows:
        w = words(r["text"])
        starts = {}
        for i, x in enumerate(w):
            starts.setdefault(x, []).append(i)
        hit, seen = set(), set()
        for item, win in wins:
            for i in starts.get(win[0], []):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    seen.add(item)
        names = sorted(str(x) for x in seen if x is not None)
        out.append((r["doc_id"], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination(awkward, items):
    got = sorted(map(tuple, contamination(awkward, items).collect()), key=repr)
    assert got == contaminated(awkward.collect(), items.collect())
    assert clean_documents(awkward, items).count() == sum(not x[5] for x in got)


def test_contamination_of_nothing(awkward, empty, items):
    assert contamination(empty, items).count() == 0
    got = contamination(awkward, items.limit(0)).collect()
    assert len(got) == awkward.count() and not any(r["contaminated"] for r in got)


def test_few_jobs_and_only_postings_with_partners(spark, monkeypatch):
    """Postings whose lists hold no similar set go at once, and what is left takes few jobs (the check on check_h)."""
    rows = [(i, " ".join(["these five words are common", *(f"w{i}_{j}" for j in range(12))])) for i in range(60)]
    rows += [(100 + i, " ".join([*(f"v{j}" for j in range(30)), f"x{i}"])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in (setjoin.Rule(), line_dedup.LINES):
        found = setjoin.candidates(docs, setjoin.describe(docs, rule), rule)
        assert {r["doc"] for r in found.select("doc").distinct().collect()} == {100, 101, 102}
    made, write = [], setjoin.materialise
    for module in (setjoin, ngram_join, line_dedup):
        monkeypatch.setattr(module, "materialise", lambda df, tag, *more: made.append(tag) or write(df, tag, *more))
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == groups(rows_ := docs.collect())
    assert len(made) <= 22
    gone = expected_lines(rows_)
    assert {r["doc_id"]: set(r["removed"]) for r in dedup_lines(docs).collect()} == {i: gone.get(i, set()) for i, _ in rows}


def test_long_and_cut_lists_keep_their_postings(monkeypatch):
    import numpy as np

    rule = line_dedup.LINES
    *_, n, fp, tokens, offset = setjoin.unit_sets(pa.array([" ".join(f"w{j}" for j in range(20)), " ".join(f"u{j}" for j in range(20)), " ".join([*(f"w{j}" for j in range(20)), "x"])]), rule)
    bits = setjoin.set_marks(tokens, offset, rule.marks).view(np.uint64)
    kept = lambda size: setjoin.partnered(np.full(3, 7, np.uint64), fp, n, np.zeros(3, np.int64), bits, np.full(3, size), rule).tolist()
    assert kept(3) == [True, False, True] and kept(4) == kept(0) == [True] * 3
    monkeypatch.setattr(setjoin, "LONG", 2)
    assert kept(3) == [True] * 3


def test_long_marks_drop_pairs_of_long_sets_that_do_not_link():
    """512 bits are full for long sets, so that any pair passes; the long marks tell, and keep every pair that links."""
    import numpy as np

    rule = setjoin.Rule()
    words = [f"w{i}" for i in range(6_000)]
    texts = [" ".join(words[:3_000]), " ".join(words[3_000:]), " ".join(words[100:3_050]), " ".join(words[:1_600]), " ".join(words[1_000:4_000]), " ".join(words[:5_900]), "a b", "a b c"]
    *_, tokens, offset = setjoin.unit_sets(pa.array(texts), rule)
    sets = [tokens[a:b] for a, b in itertools.pairwise(offset.tolist())]
    short = setjoin.set_marks(tokens, offset, rule.marks).view(np.uint64)
    long = [np.frombuffer(setjoin.long_marks(s), "<u8") for s in sets]
    assert int(np.bitwise_count(short[0] ^ short[1]).sum()) <= 2 * 2_996 - 2 * rule.overlap(2 * 2_996)
    links = {(i, j) for i, j in itertools.product(range(len(sets)), repeat=2) if similar(set(sets[i].tolist()), set(sets[j].tolist()))}
    kept = {(i, j) for i, j in itertools.product(range(len(sets)), repeat=2) if setjoin.long_near(long[i], long[j], rule)}
    assert links <= kept and (0, 2) in links and not {(0, 1), (1, 0), (0, 3), (0, 5), (5, 0)} & kept


def test_texts_that_share_only_a_passage_are_not_read_again(spark, monkeypatch):
    """Long texts with one passage in common meet in their lists, but no set of theirs is sent to be counted."""
    read, write = {}, setjoin.materialise

    def counting(df, tag, *more):
        got = write(df, tag, *more)
        read[tag] = read.get(tag, 0) + (got.count() if tag in ("tried", "crossing") else 0)
        return got

    for module in (setjoin, ngram_join):
        monkeypatch.setattr(module, "materialise", counting)
    rows = [(i, " ".join([*(f"p{j}" for j in range(40)), *(f"w{i}_{j}" for j in range(3_000))])) for i in range(12)]
    rows += [(100, rows[0][1] + " x"), (101, rows[3][1] + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == groups(docs.collect())
    assert read["tried"] + read["crossing"] == 2


def test_no_step_leaves_its_tables_or_shuffle_files(spark, monkeypatch, tmp_path):
    """The disk holds what later steps read: of all tables one is left, which the result reads, and the setting is as before."""
    import os

    from cataloom import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    before = spark.conf.get(session.CLEANUP)
    rows = copies_that_link_in_part(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = near_duplicates(docs)
    assert [x.split("-")[0] for x in os.listdir(tmp_path / "cataloom") if not x.startswith("edges")] == ["named"]
    assert sorted(map(tuple, got.collect()), key=repr) == groups(docs.collect())
    assert spark.conf.get(session.CLEANUP) == before


@pytest.mark.parametrize("limit", [0, 1_000])
def test_components_by_one_task_and_by_steps(spark, limit):
    from cataloom.llm.common import components

    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(-30, 20)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(300, 301), (301, 300), (5, 5)]
    home = {x: x for e in edges for x in e}
    for _ in home:
        for u, v in edges:
            home[u] = home[v] = min(home[u], home[v])
    alone = {u for u, v in edges if u == v and sum(u in e for e in edges) == 1}
    got = components(spark.createDataFrame(edges, "u long, v long"), limit).collect()
    assert sorted(map(tuple, got)) == sorted((x, c) for x, c in home.items() if x not in alone)
