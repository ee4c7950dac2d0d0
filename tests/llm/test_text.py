"""Problems 6, 7 and 8 against brute force."""

import bisect
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import leakage, packing, queries, sameform


def best_fit(sizes, capacity):
    gaps, n = [], 0
    for x in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, x)
        rest = gaps.pop(i) - x if i < len(gaps) else capacity - x
        n += i >= len(gaps) and rest == capacity - x
        bisect.insort(gaps, rest)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=200))
def test_plan_is_best_fit(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    steps, opened = packing.plan(counts, 30)
    used, placed = {}, dict.fromkeys(counts, 0)
    for size, first, end, container, each in steps:
        for r in range(first, end):
            c = container + (r - first) // each
            used[c] = used.get(c, 0) + size
        placed[size] += end - first
    assert placed == counts and all(v <= 30 for v in used.values()) and len(used) == opened == best_fit(sizes, 30)


def sweeps(sizes, capacity):
    """Bulk-synchronous best fit item by item: harmonic classes, largest first; gaps in order take the largest open item that fits, all at once; repeated."""
    bounds = [capacity, *(capacity // k for k in range(2, 9)), *(capacity // 8 >> k for k in range(1, 20)), 0]
    gaps, opened, rounds = [], 0, 0
    for high, low in itertools.pairwise(bounds):
        items = [x for x in sizes if low < x <= high]
        while items:
            items.sort()
            left, stack, i, matched = [], [], 0, False
            for g in sorted(gaps):
                while i < len(items) and items[i] <= g:
                    stack.append(items[i])
                    i += 1
                if stack:
                    g, matched = g - stack.pop(), True
                left += [g] if g else []
            gaps, items, rounds = left, stack + items[i:], rounds + 1
            if not matched:
                items.sort(reverse=True)
                while items:
                    each = capacity // items[0]
                    opened += 1
                    gaps += [capacity - sum(items[:each])]
                    items = items[each:]
    return opened, rounds


@pytest.mark.parametrize("seed", range(4))
def test_plan_against_sweeps(seed):
    """The plan needs no more containers than the method as named does, which takes many rounds over all items and gaps."""
    rng = random.Random(seed)
    sizes = [min(400, max(1, int(rng.lognormvariate(4, 1)))) for _ in range(3000)]
    _, planned = packing.plan({s: sizes.count(s) for s in set(sizes)}, 400)
    opened, rounds = sweeps(sizes, 400)
    assert -(-sum(sizes) // 400) <= planned <= opened and rounds > 20


@pytest.mark.parametrize("group", [10, 10**6])
def test_pack(spark, group):
    rng = random.Random(5)
    sizes = [(i, rng.choice([7, 7, 7, 1, 40, 99, 100, 250, 0])) for i in range(300)] + [(1, 7), (None, 4), (5000, None)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint").repartition(3), 100, group).collect()
    by = {}
    for r in rows:
        assert (r.container is None) == (r.tokens == 0) and r.tokens <= 100
        by[r.container] = by.get(r.container, 0) + r.tokens
    real = [s for i, s in sizes if i is not None and s]
    assert sum(r.tokens for r in rows) == sum(real) and all(v <= 100 for k, v in by.items() if k is not None)
    pieces = [p for s in real for p in [100] * (s // 100) + [s % 100] if p]
    assert len(by.keys() - {None}) == best_fit(pieces, 100)
    whole = [r for r in rows if r.piece > 0]
    assert {r.doc_id for r in whole} == {i for i, s in sizes if i is not None and (s or 0) > 100}
    assert packing.fill(packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"))).first()["containers"] == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), 0)


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox", 5), (2, "", 1), (3, None, 1), (None, "x", 1), (4, "a " * 20000, 1)], "doc_id bigint, text string, tokens int")
    got = {r.doc_id: r.tokens for r in packing.token_counts(docs).collect()}
    assert got[1] == 4 and got[2] == 0 and set(got) == {1, 2, 4} and got[4] > 15000


ITEM = "Suppose that sluice number 10 mends the glazed pergola before any viaduct is moved, and the woven kiln keeps a tally of 7 querns"


@pytest.mark.parametrize("bits", [leakage.FILTER_BITS, 6])
def test_leaks(spark, monkeypatch, bits):
    """With 6 bits the filter lets almost everything pass."""
    monkeypatch.setattr(leakage, "FILTER_BITS", bits)
    w = ITEM.split()
    swapped = [*w]
    for i in range(5, len(w), 9):
        swapped[i] = "other"
    docs = [
        (1, "before " + ITEM.upper() + " after"), (2, "> " + "\n> ".join(ITEM.split())), (3, " ".join(f"**{x}**" for x in w[2:14])), (4, " ".join(w[2:13])), (5, " ".join(swapped)), (6, None), (7, ""),
        (8, ITEM.replace("e", "е").replace("a", "а")), (9, ITEM.replace("s", "s​")), (10, "<p>" + "</p> <p>".join(w) + "</p>"), (11, "x " * 3000 + ITEM), (None, ITEM), (12, " ".join(reversed(w))), (1, "before " + ITEM.upper() + " after"),
    ]
    bench = [(100, ITEM), (101, " ".join(w[:12]) + " something else entirely here now"), (102, "short"), (103, None), (None, ITEM), (100, ITEM)]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    found = leakage.hits(d, b)
    want = {(k, i) for k, t in docs for i, x in bench if k is not None and i is not None and runs(t, x)}
    assert {tuple(r) for r in leakage.leaked(found).collect()} == want
    assert {(1, 100), (2, 100), (3, 100), (8, 100), (9, 100), (10, 100), (11, 100), (1, 101)} <= want and not any(k in (4, 5, 12) for k, _ in want)
    near = {(r.doc_id, r.item_id): r.best_equal for r in leakage.overlaps(found).collect()}
    assert near[(5, 100)] in (10, 11) and near[(1, 100)] == 12
    assert leakage.hits(d.limit(0), b).count() == 0 and leakage.hits(d, b.limit(0)).count() == 0


def test_markup_of_any_length():
    style = 'style="' + "color: red; " * 200 + '"\n class=x disabled'
    w = ITEM.split()
    assert leakage.words_of(f"<span {style}>" + f"</span> <span {style}>".join(w) + "</span><!-- not\nread -->") == leakage.words_of(ITEM)
    assert leakage.words_of("a < b and <!-- c") == ["a", "b", "and", "c"]
    assert len(leakage.words_of("<a " * 100_000)) == 100_000 and len(leakage.words_of("<!-- x " * 100_000)) == 100_000


@pytest.mark.parametrize("replaced", [1, 2, 3])
def test_recall_of_windows_with_replaced_words(replaced):
    """Recall 1.0, for every set of one, two or three replaced words."""
    sets = list(itertools.combinations(range(leakage.SPAN), replaced))
    assert sum(any(all(m[i] == "0" for i in lost) for m in leakage.MASKS) for lost in sets) == len(sets)


def test_masks_cover_every_set_of_replaced_words():
    assert all(any(all(m[i] == "0" for i in lost) for m in leakage.MASKS) for lost in itertools.combinations(range(leakage.SPAN), leakage.TOLERATED))


@pytest.mark.parametrize("name", ["p7_found", "p7_overlaps"])
def test_queries_seed_with_every_mask(spark, monkeypatch, tmp_path, name):
    """Both queries take the seeds of all masks, of which one covers each set of replaced words, for documents and items; p7_found gives the equal windows among them."""
    w, used = ITEM.split(), []
    docs = [(1, "before " + ITEM), (2, " ".join("other" if i % 5 == 0 else x for i, x in enumerate(w)))]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    real = leakage.seed_filter
    monkeypatch.setattr(leakage, "seed_filter", lambda tests: (used.append(tests.distinct().count()), real(tests))[1])
    got = {(r.doc_id, r.item_id) for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    assert got == ({(1, 100)} if name == "p7_found" else {(1, 100), (2, 100)})
    assert used == [len(leakage.MASKS) * (len(leakage.words_of(ITEM)) - leakage.SPAN + 1)]


def test_overlaps_against_brute_force(spark):
    w, docs = [x.casefold() for x in ITEM.split()], []
    for stride in (4, 5, 7, 9):
        docs += [" ".join(f"other{i}" if i % stride == first else x for i, x in enumerate(w)) for first in range(stride)]
    docs += [" ".join(random.Random(k).choice([x, x, x, "other"]) for x in w) for k in range(20)]
    docs.append("before " + ITEM)
    want = set()
    for k, t in enumerate(docs):
        x, y = leakage.words_of(t), leakage.words_of(ITEM)
        equal = {(i, j): sum(a == b for a, b in zip(x[i : i + 12], y[j : j + 12])) for i in range(len(x) - 11) for j in range(len(y) - 11)}
        want |= {(k, i, j, e) for (i, j), e in equal.items() if e >= 9}
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    b = spark.createDataFrame([(100, ITEM)], "item_id bigint, text string")
    assert {(r.doc_id, r.doc_at, r.item_at, r.equal) for r in leakage.hits(d, b).collect()} == want
    assert {(r.doc_id, r.doc_at, r.item_at, r.equal) for r in leakage.hits(d, b, 0).collect()} == {x for x in want if x[3] == 12} != set()
    assert {r[0] for r in leakage.overlaps(leakage.hits(d, b)).collect()} == {k for k, *_ in want} >= set(range(4, 25))


def runs(a, b):
    x, y = leakage.words_of(a), leakage.words_of(b)
    theirs = {tuple(y[i : i + 12]) for i in range(len(y) - 11)}
    return any(tuple(x[i : i + 12]) in theirs for i in range(len(x) - 11))


SAME = [("café", "café"), ("ｆｕｌｌ", "full"), ("a​b", "ab"), ("x y", "x y"), ("ﬁne", "fine"), ("сору", "copy"), ("a‑b", "a-b"), ("Ａ̊", "Å"), ("ạ̇", "ạ̇"), ("が", "が"), ("한", "한"), ("ΑΒ", "AB"), ("K", "K"), ("", "​")]
OTHER = [("a", "A"), ("e", "é"), ("2", "²"), ("1", "①"), ("1/2", "½"), ("l", "1"), ("a b", "a\nb"), ("a.b", "a,b"), ("-", "_"), ("’", "'")]


def test_one_form():
    assert all(sameform.same_form(a) == sameform.same_form(b) for a, b in SAME)
    assert all(sameform.same_form(a) != sameform.same_form(b) for a, b in OTHER)
    assert sameform.same_form(None) is None


def test_frames_agree_with_strings(spark):
    rng = random.Random(8)
    pool = [*"aeо ЕＡé", "́", "̣", "​", " ", "ﬁ", "か", "゙", "한", "ᄒ", "ᅡ", "ᆫ", "²", "\n", "‑", "🙂"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(14))) for _ in range(400)] + [x for p in SAME + OTHER for x in p] + ["é" * 20000, None, "", "plain"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, "plain", "plain"])] + [(None, "café", "x"), (1, texts[1], "clash")], "doc_id bigint, text string, form string").repartition(5)
    got = {r.doc_id: r.form for r in sameform.canonical_texts(docs).collect() if r.doc_id is not None}
    every = [*texts, "plain", "plain"]
    assert all(got[i] == sameform.same_form(t) for i, t in enumerate(every))
    forms = [sameform.same_form(t) for t in every]
    want = {(i, j) for i in range(len(every)) for j in range(i + 1, len(every)) if every[i] is not None and every[j] is not None and forms[i] == forms[j] and every[i] != every[j]}
    assert {tuple(r) for r in sameform.equal_looking_pairs(docs).collect()} == want
    classes = {r.doc_id: r.representative for r in sameform.look_classes(docs).collect()}
    assert all(classes[i] == min(k for k, f in enumerate(forms) if f == forms[i]) for i, t in enumerate(every) if t is not None)
    assert sameform.equal_looking_pairs(docs.limit(0)).count() == 0
