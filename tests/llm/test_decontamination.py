"""Leaks: exact, re-parameterised and inconsistent passages."""

from provenspark.llm import decontamination as D

ITEM = "A baker in Lyon sells 12 loaves for 30 euros while the miller in Lyon sells 12 sacks of flour, so how many loaves does each sack make in Lyon today."
OTHER = "Rivers carry sand slowly toward wide deltas where long roots hold the mud and small birds wait for the tide to fall each evening."
CLEAN = "Nothing here has anything to do with the questions of the list, it merely goes on for a while about weather and boats and the price of rope."


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def found(spark, make, docs, items=((1, ITEM), (2, OTHER))):
    return {(r.doc_id, r.item_id): r.kind for r in D.leaks(make(docs), bench(spark, items)).collect()}


def test_kinds(spark, make):
    new = ITEM.replace("Lyon", "Porto").replace("12", "70").replace("30", "95")
    mixed = ITEM.replace("in Lyon sells 12 loaves", "in Porto sells 12 loaves").replace("makes in Lyon", "make in Turin")
    docs = [(1, "Some words first. " + ITEM + " And more."), (2, CLEAN + " " + new), (3, mixed.replace("miller in Lyon", "miller in Turin")), (4, CLEAN), (5, OTHER.upper()), (6, " | ".join(OTHER.split()))]
    got = found(spark, make, docs)
    assert got[1, 1] == "exact" and got[2, 1] == "reparameterised"
    assert (4, 1) not in got and (4, 2) not in got
    assert got[5, 2] == "exact" and got[6, 2] == "exact"
    # one town became two: slots disagree wherever both occur in one alignment
    assert (3, 1) not in got


def test_edges(spark, make):
    docs = [(1, None), (2, ""), (None, ITEM), (4, ITEM), (4, ITEM), (5, "cat dog bird " * 3), (6, (CLEAN + " ") * 2000 + ITEM)]
    got = found(spark, make, docs, ((1, ITEM), (1, ITEM), (2, None), (3, ""), (None, OTHER), (4, "cat dog bird")))
    assert got == {(4, 1): "exact", (6, 1): "exact", (5, 4): "exact"}
    assert found(spark, make, docs, ()) == {}
    assert D.leaks(make(docs).limit(0), bench(spark, [(1, ITEM)])).count() == 0
    kept = D.clean(make(docs), bench(spark, [(1, ITEM)]))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5] and kept.columns == make(docs).columns


def test_planted_passages(spark, docs, small):
    """Every document that holds a whole item, by plain search, is found."""
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if r.text in t}
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()}
    assert want <= got
    squeeze = lambda s: [w.strip(".,!*#$%&|") for w in s.lower().split()]
    for i, j in got - want:  # others hold most of the item's words in a row
        a = squeeze(texts[i])
        b = squeeze(next(r.text for r in items.where(f"item_id = {j}").collect()))
        grams = {tuple(a[k : k + 8]) for k in range(len(a))}
        assert sum(tuple(b[k : k + 8]) in grams for k in range(len(b) - 7)) >= 0.4 * (len(b) - 7)


def test_items_of_few_words(spark, make):
    """Windows with few literals meet by their values; templates still count by themselves."""
    items = [(1, "Calculate 12 + 7 * 3 - 4 / 2"), (2, "Zanzibar"), (3, "mix 3 cups into 5"), (4, "Ada Bo Cy Di Eve Flo Gus Hal Ida Jon")]
    items.append((5, "Each tray holds exactly 12 ripe plums while baskets hold 9 and the codes are 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23"))
    held = [(i, f"{CLEAN} {t} {CLEAN}") for i, t in items]
    got = found(spark, make, [*held, (6, CLEAN), (7, f"{CLEAN} mix 8 cups into 9"), (8, f"{CLEAN} Calculate 5 + 9")], items)
    assert {(i, i) for i, _ in items} <= set(got) and all(got[i, i] == "exact" for i, _ in items)
    assert got[7, 3] == "reparameterised"
    assert {d for d, _ in got} == {1, 2, 3, 4, 5, 7}


def test_a_copy_in_another_case(spark, make):
    names = "yesterday Anna Bell met Carl Dorn near Essen Forum and then Greta Holm left for Ilmenau Jena with Karl Lund and Mia Nord"
    assert found(spark, make, [(1, names.upper()), (2, names.lower()), (3, CLEAN)], [(1, names)]) == {(1, 1): "exact", (2, 1): "exact"}


def test_names_that_open_a_sentence(spark, make):
    item = "Tom has 3 apples. Tom buys 4 more. How many apples does Tom have?"
    assert found(spark, make, [(1, item.replace("Tom", "Ann")), (2, f"{CLEAN} {item.replace('Tom', 'Ann').replace('3', '8')}"), (3, CLEAN)], [(1, item)]) == {(1, 1): "reparameterised", (2, 1): "reparameterised"}


def test_an_edited_slot_costs_its_windows_only(spark, make):
    one = ITEM.replace("sells 12 sacks", "sells 13 sacks")
    item = "The boy carries 3 apples and 5 pears up the long hill before he sells 3 apples and 5 pears to the old man."
    merged = item.replace("3", "4").replace("5", "4")
    got = found(spark, make, [(1, f"{CLEAN} {one}"), (2, f"{CLEAN} {merged}"), (3, CLEAN)], [(1, ITEM), (2, item)])
    assert got == {(1, 1): "reparameterised", (2, 2): "reparameterised"}


def _template(text):
    """(tokens, kinds) by plain rules, for texts whose names never open a sentence."""
    out, kinds, number = [], [], False
    for raw in text.split():
        word = raw.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
        if not word:
            continue
        kind = "number" if word[0].isdigit() else "unit" if number and word.lower() in D.UNITS else "name" if word[0].isupper() and word[1:2].islower() else ""
        number = kind == "number"
        out.append(word.lower())
        kinds.append(kind)
    return out, kinds


def _plain_leak(doc, item):
    """Coverage of an item's windows by one document, template windows with agreeing slots and equal ones, over all alignments."""
    (dw, dk), (iw, ik) = _template(doc), _template(item)
    total, typed_total = len(iw) - 7, sum(sum(not k for k in ik[p : p + 8]) >= 4 for p in range(len(iw) - 7))
    every, typed = set(), set()
    for shift in range(-len(iw), len(dw)):
        met = []
        for p in range(len(iw) - 7):
            if 0 <= p + shift and p + shift + 8 <= len(dw):
                a, b = range(p, p + 8), range(p + shift, p + shift + 8)
                same = all(iw[x] == dw[y] for x, y in zip(a, b, strict=True))
                form = all((ik[x] == dk[y] != "") or (ik[x] == dk[y] == "" and iw[x] == dw[y]) for x, y in zip(a, b, strict=True)) and sum(not ik[x] for x in a) >= 4
                met += [(p, form)] if same or form else []
        votes = {}
        for p, form in met:
            for x in range(p, p + 8):
                if ik[x] and form:
                    votes.setdefault(iw[x], {}).setdefault(dw[x + shift], set()).add(x)
        mapped = {a: min(by, key=lambda b: (-len(by[b]), b != a)) for a, by in votes.items()}
        if any(2 * len(by[mapped[a]]) < len(set().union(*by.values())) for a, by in votes.items()):
            continue
        for p, form in met:
            if not form or all(mapped[iw[x]] == dw[x + shift] for x in range(p, p + 8) if ik[x]):
                every.add(p)
                typed |= {p} if form else set()
    enough = lambda k, n: n > 0 and k / n >= D.COVER and k >= min(D.LEAST, n)
    return enough(len(every), total) or enough(len(typed), typed_total)


def test_templates_equal_a_plain_search(spark, make):
    import random

    r = random.Random(7)
    names, words = ["Alba", "Bruno", "Celia", "Dario", "Elsa", "Fabio"], [f"w{a}{b}" for a in "abcdefghij" for b in "klmnop"]

    def text(n):
        out = []
        for _ in range(n):
            x = r.random()
            out += [r.choice(names)] if x < 0.15 else [str(r.randint(2, 99)), "km"] if x < 0.22 else [str(r.randint(2, 99))] if x < 0.3 else [r.choice(words)]
        return ["so", *out]

    items = {i: text(r.randint(14, 40)) for i in range(1, 9)}
    docs = {}
    for d in range(1, 121):
        w = list(items[r.randint(1, 8)])
        change = {a: r.choice(names) for a in names} if r.random() < 0.6 else {}
        w = [change.get(x, x) for x in w]
        w = [str(r.randint(2, 99)) if x.isdigit() and r.random() < 0.3 else r.choice(words) if not x[0].isupper() and not x.isdigit() and x != "km" and r.random() < 0.08 else x for x in w]
        cut = r.randint(0, len(w) - 3)
        docs[d] = text(r.randint(0, 20)) + (w if r.random() < 0.6 else w[cut:]) + text(5)
    docs, items = ({k: " ".join(w) for k, w in of.items()} for of in (docs, items))
    want = {(d, i) for d, t in docs.items() for i, s in items.items() if _plain_leak(t, s)}
    got = set(found(spark, make, list(docs.items()), tuple(items.items())))
    assert got == want and 30 < len(want) < 110
