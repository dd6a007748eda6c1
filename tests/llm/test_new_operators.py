"""Conversation repair, page text and manifests against plain brute force."""
import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cataloom.llm import conversations
from cataloom.llm.conversations import damage, repair_report, repaired_turns, find_repairs, mark_faults
from cataloom.llm.extract import extract, main_text, page_blocks
from cataloom.llm.merkle import fold, leaf_hash, manifest, siblings

BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_faults(turns):
    """(role, text, fault) in order; turns: (turn, role, text)."""
    ordered = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, out = set(), []
    for _, role, text in ordered:
        shown = text.strip(BLANKS)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def legal(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def cheapest(rows):
    """Least (cost, letters, repaired lines) over all edit sequences, any number of inserts, by a uniform-cost search."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, letters, lines
        if (at, state) in done:
            continue
        done.add((at, state))
        for initial, role in (("u", "user"), ("a", "assistant")):
            if legal(state, initial):
                heapq.heappush(heap, (cost + 2, letters + "I", at, legal(state, initial), (*lines, f"{role}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 3, letters + "D", at + 1, state, lines))
        if fault in (None, "truncated"):
            more = int(fault == "truncated")
            if legal(state, role[:1]):
                heapq.heappush(heap, (cost + more, letters + "K", at + 1, legal(state, role[:1]), (*lines, f"{role}:{text}")))
            for initial, name in (("u", "user"), ("a", "assistant")):
                if legal(state, initial):
                    heapq.heappush(heap, (cost + 2 + more, letters + "R", at + 1, legal(state, initial), (*lines, f"{name}:{text}")))


def plain_report(turns, convs):
    out = []
    for conv in set(convs):
        mine = [(t, r, x) for c, t, r, x in turns if c == conv]
        rows = plain_faults([(t, " " if r is None else r, " " if x is None else x) for t, r, x in mine])
        numbers = {t for t, _, _ in mine if t is not None}
        cost, letters, lines = cheapest(rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        count = {k: sum(f == k for _, _, f in rows) for k in ("blank", "duplicate", "truncated")}
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *count.values(), illegal, cost, letters,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_turns(rng, convs, most):
    texts = ["Hi.", "What?", "No end", "", "  \n", None, "Ünï!  ", "ok.\t", "a\nb"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(0, most)):
            rows.append((None if c == 0 else c, None if rng.random() < 0.1 else t + rng.randint(0, 1), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randint(0, 99)}."))
    return rows


@pytest.mark.parametrize("window", [1, 2, 64])
def test_repairs_equal_a_search_over_all_edits(spark, monkeypatch, window):
    monkeypatch.setattr(conversations, "WINDOW", window)
    monkeypatch.setattr(conversations, "_WIDTH", 3 * (2 * window + 3))
    for seed in range(400):
        rng = random.Random(seed)
        rows = [("".join(rng.choice("suaxsua")) + "x", "t", rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 9))]
        search = conversations._Search()
        for role, _, fault in rows:
            search.feed(None, role[:1], fault)
        cost, letters, lines = cheapest(rows)
        assert search.end() == (cost, letters)
        edits = list(conversations._edits(letters, search.turns))
        assert len(edits) == len(rows) and "".join(a for a, _ in edits) == letters
        assert [t for _, ts in edits for t in ts if t != "-"] == [line[0] for line in lines]


def test_repair_report(spark):
    rows = random_turns(random.Random(5), 60, 12) + [(99, i, "user", f"same {i % 7}") for i in range(200)]
    given = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rank string").repartition(5)
    got = sorted(map(tuple, repair_report(given, given).collect()), key=repr)
    assert got == plain_report(rows, [r[0] for r in rows])
    harmed = damage(given)
    assert sorted(map(tuple, harmed.collect()), key=repr) == sorted(plain_damage(rows), key=repr)
    assert sorted(map(tuple, repair_report(harmed, given).collect()), key=repr) == plain_report(plain_damage(rows), [r[0] for r in rows])


def test_repaired_turns_hold_the_texts(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "cut"), (1, 2, "user", "U."), (1, 2, "user", "U."), (1, 3, "tool", "T.")]
    marked = mark_faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = repaired_turns(marked, find_repairs(marked)).orderBy("place", "step").collect()
    cost, letters, lines = cheapest(plain_faults([r[1:] for r in rows]))
    assert [f"{r['role']}:{r['text']}" for r in got] == list(lines)
    assert "".join(r["edit"] for r in got) == letters.replace("D", "")


def test_repair_of_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    some = spark.createDataFrame([(3, 1, "user", "x."), (None, None, None, None)], none.schema)
    assert repair_report(none, none).count() == 0
    got = sorted(map(tuple, repair_report(none, some).collect()), key=repr)
    assert got == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (None, 3)], key=repr)


def plain_manifest(rows):
    """rows (group, doc_id, leaf) -> {index: (subroot, root, proof, siblings by level)}, by lists of lists."""
    def tree(level):
        """Root, and per position its siblings before and behind at each level."""
        paths, spots = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, spot in enumerate(spots):
                run = level[spot // 3 * 3:spot // 3 * 3 + 3]
                paths[i].append((run[:spot % 3], run[spot % 3 + 1:]))
                spots[i] = spot // 3
            level = [hashlib.sha256("".join(level[i:i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
        return level[0], paths

    groups = {}
    for i, (group, doc, leaf) in enumerate(rows):
        groups.setdefault(group, []).append(((doc is not None, doc or 0, leaf), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([k[2] for k, _ in sorted(groups[g])]) for g in names]
    root, tops = tree([t[0] for t in trees])
    out = {}
    for name, (subroot, paths), top in zip(names, trees, tops):
        for (_, i), path in zip(sorted(groups[name]), paths):
            out[i] = (subroot, root, path + top)
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels):
    rng = random.Random(3)
    rows = [(rng.choice([None, "", "a", "b", "ä", "Z"]) if i < 60 else "hot" if i < 300 else f"g{i % 37}" if i < 400 else f"one{i}", None if i % 50 == 0 else i * 7919 % 1009, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(420)]
    rows += [rows[70]] * 3
    given = spark.createDataFrame([(g, d, x, i, "y") for i, (g, d, x) in enumerate(rows)], "source string, doc_id long, leaf string, i int, path string").repartition(5)
    found = manifest(given, keep=("i",), levels=levels).withColumn("again", fold(F.col("leaf"), F.col("path"))).withColumn("proof", siblings(F.col("path")))
    want, got = plain_manifest(rows), found.collect()
    assert sorted(r["i"] for r in got) == list(range(len(rows)))
    repeated = [i for i, r in enumerate(rows) if r == rows[70]]
    for r in got:
        subroot, root, path = want[r["i"]]
        assert (r["leaf"], r["subroot"], r["root"], r["again"]) == (rows[r["i"]][2], subroot, root, root)
        if r["i"] not in repeated:
            assert [(p["left"], p["right"]) for p in r["path"]] == [("".join(a), "".join(b)) for a, b in path]
            assert r["proof"] == "".join(itertools.chain.from_iterable(a + b for a, b in path))
    assert sorted(r["proof"] for r in got if r["i"] in repeated) == sorted("".join(itertools.chain.from_iterable(a + b for a, b in want[i][2])) for i in repeated)


def test_manifest_of_one_row_and_none(spark, empty, awkward):
    one = spark.createDataFrame([("s", 1, "ab")], "source string, doc_id long, leaf string")
    assert [tuple(r) for r in manifest(one).collect()] == [(1, "ab", "ab", "ab", [])]
    assert manifest(empty.withColumn("leaf", F.lit("x"))).count() == 0
    hashed = awkward.withColumn("leaf", leaf_hash(*[F.col(c) for c in ("doc_id", "source", "text")]))
    got = manifest(hashed).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = awkward.collect()
    assert sorted(r["leaf"] for r in got) == sorted(hashlib.sha256("".join(field(r[c]) for c in ("doc_id", "source", "text")).encode()).hexdigest() for r in rows)
    assert len({r["root"] for r in got}) == 1


LONG = "The house of the river is one that was built in a year of war, and it has been there for all to see since then."
PAGES = {
    # Boxes with and without names around and inside an article; entities, inline markup, br, unclosed and nested elements.
    f"<html><head><title>T &amp; x</title><style>p{{}}</style></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></ul></nav>"
    f"<div class='cookie-notice'><p>{LONG}</p></div><main id=main><article class='post comments-open'><header><h1><a href='/x'>A  title</a></h1></header>"
    f"<p>{LONG} caf&eacute;<br>b<b>ol</b>d &lt;i&gt; &#8364;5<p>Short.<div class='ad'>Buy it</div><p>One <a href='u'>link</a> in the text of this is fine.</p>"
    f"<aside>{LONG}</aside><form><label>Mail</label><input name=m><button>Send</button></form><script>var a='<p>no</p>';</script><ul><li>first<li>second</ul></article>"
    f"<section id='comments'><article class='comment'><p>{LONG}</p></article></section></main><div id='sidebar'>{LONG}</div><footer>&copy; x</footer></body></html>":
    f"A title {LONG} café bold <i> €5 Short. One link in the text of this is fine. first second",
    # No article: long blocks with stop words, a heading before one, a short block between two.
    f"<body><div><a href=1>One</a> <a href=2>Two</a></div><h2>Head</h2><p>{LONG}</p><p>Then.</p><p>{LONG}</p><div><a href='x'>{LONG}</a></div><p>&copy; 2020 of us</p></body>": f"Head {LONG} Then. {LONG}",
    f"<div class=menu>{LONG}</div><div class='entry-content'>x1 y2</div><p>{LONG}</p>": "x1 y2",
    f"<article><!-- <p>no</p> --><p title=\"a > b\">{LONG}</p><p style='display:none'>{LONG}</p><svg><text>n</text></svg>a < b &amp;amp; c&nbsp;&nbsp;d": f"{LONG} a < b &amp; c d",
    "<nav>Menu</nav><footer>End</footer>": "",
    "": "", "<": "<", "plain words only": "plain words only", "<script>x": "", "<!-- open": "", "<article></article>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text(page)[0] == PAGES[page]


def test_extract(spark):
    pages = [(i, page, "clash", i) for i, page in enumerate([*PAGES, None, "<article>" + "<p>long one.</p>" * 20_000])]
    given = spark.createDataFrame([*pages, pages[0]], "page_id long, html string, text string, n_kept int").repartition(3)
    got = {(r["page_id"], r["text"]) for r in extract(given).collect()}
    assert got == {(i, PAGES.get(page, "" if page is None else " ".join(["long one."] * 20_000))) for i, page, _, _ in pages}
    assert extract(given).count() == len(pages) + 1 and extract(given.limit(0)).count() == 0
    first = [r for r in page_blocks(given).where("page_id = 1").orderBy("block").collect()]
    assert " ".join(r["text"] for r in first if r["label"] == "good") == list(PAGES.values())[1] and [r["block"] for r in first] == list(range(len(first)))


def test_extract_equals_the_articles(spark, small):
    """In these pages the article is what lies between its tags."""
    import html
    import re

    for r in extract(spark.read.parquet(f"{small}/pages.parquet")).collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
