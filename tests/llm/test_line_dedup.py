import random

import pytest

from pagequarry.llm import line_dedup as op


def longest(pairs):
    """Length of the longest chain, over all pairs of pairs."""
    pairs = sorted(pairs)
    best = []
    for i, (a, b) in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(i) if pairs[j][0] < a and pairs[j][1] < b), default=0))
    return max(best, default=0)


def test_chain_is_longest_and_rises():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(12)
        pairs = list(zip(rng.sample(range(30), n), rng.sample(range(30), n), strict=True))
        chain = op.longest_chain(pairs)
        there = dict(pairs)
        assert len(chain) == longest(pairs)
        assert chain == sorted(chain) and [there[x] for x in chain] == sorted(there[x] for x in chain)


def brute(texts, min_words=4):
    """Positions that an alignment with any earlier document deletes, over all pairs."""

    def lines(text):
        seen, out = {}, []
        for at, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\f\x0b")
            if line:
                out.append((at, (line, seen.get(line, 0)), len(line.split())))
                seen[line] = seen.get(line, 0) + 1
        return out

    cut = {doc: lines(text) for doc, text in texts.items()}
    gone = {doc: set() for doc in texts}
    for later, own in cut.items():
        for earlier in texts:
            if earlier < later:
                there = {key: n for n, (_, key, _) in enumerate(cut[earlier])}
                chain = op.longest_chain([(n, there[key]) for n, (_, key, _) in enumerate(own) if key in there])
                block = []
                for n in [*chain, None]:
                    if block and (n is None or n != block[-1] + 1 or there[own[n][1]] != there[own[block[-1]][1]] + 1):
                        if sum(own[x][2] for x in block) >= min_words:
                            gone[later] |= {own[x][0] for x in block}
                        block = []
                    block.append(n)
    return gone


def removed(table, texts):
    rows = op.dedup_lines(table([(i, t, None) for i, t in texts.items()]), removed="removed").collect()
    for row in rows:
        left = [x for i, x in enumerate(texts[row.doc_id].split("\n")) if i not in row.removed]
        assert row.text == "\n".join(left)
    return {row.doc_id: set(row.removed) for row in rows}


def test_against_brute_force(table):
    rng = random.Random(2)
    lines = [f"line number {i} of a few words" for i in range(25)]
    texts = {i: "\n".join(rng.choices(lines, k=rng.randrange(1, 12))) for i in range(60)}
    assert removed(table, texts) == brute(texts)


@pytest.mark.parametrize("seed", [3, 4])
def test_lines_of_many_holders_in_any_order(table, seed):
    rng = random.Random(seed)
    # Each line is in 5 to 50 of 120 documents; short ones need a neighbour.
    lines = [f"line {i}" if i % 3 else f"a line of enough words {i}" for i in range(40)]
    share = {line: rng.randrange(5, 51) / 120 for line in lines}
    texts = {}
    for i in range(120):
        own = [line for line in lines if rng.random() < share[line]]
        if rng.random() < 0.5:
            rng.shuffle(own)
        for _ in range(rng.randrange(3)):
            own.insert(rng.randrange(len(own) + 1), rng.choice(["", f"only here {i} {rng.random()}"]))
        texts[i] = "\n".join(own)
    want = brute(texts)
    assert removed(table, texts) == want
    assert sum(map(len, want.values())) > 500


def test_lines_that_cross_the_first_holder(table):
    a, b = "the first long line here", "the second long line here"
    texts = {1: f"{a}\n{b}"}
    texts |= {k: f"{b}\n{a}" + (f"\nonly in document {k}" if k > 1 else "") for k in range(2, 9)}
    found = removed(table, texts)
    assert found == brute(texts)
    assert all(found[k] == {0, 1} for k in range(3, 9))


def test_a_line_of_a_third_of_all_documents(table):
    rng = random.Random(5)
    hot = "a line that many documents share"
    texts = {}
    for i in range(300):
        own = [f"own line {i} {k} of some words" for k in range(rng.randrange(4))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), hot)
        texts[i] = "\n".join(own)
    found = removed(table, texts)
    assert found == brute(texts)
    assert sum(map(len, found.values())) == 99


def test_blocks_shorter_than_a_few_words_stay(table):
    docs = table([(1, "Two words\nfour words are enough", None), (2, "Two words\nmy own\nfour words are enough", None)])
    assert {r.doc_id: r.text for r in op.dedup_lines(docs).collect()}[2] == "Two words\nmy own"
    block = table([(1, "two words\nand two", None), (2, "two words\nand two\nmore", None)])
    assert {r.doc_id: r.text for r in op.dedup_lines(block).collect()}[2] == "more"


def test_blocks_run_over_blank_lines_and_on_both_sides(table):
    def left(*texts):
        docs = table([(i, t, None) for i, t in enumerate(texts)])
        return {r.doc_id: r.text for r in op.dedup_lines(docs).collect()}[len(texts) - 1]

    # A title between blank lines goes with what is around it.
    text = "a title\n\nfour words are enough\n\nthat it"
    assert left(text, text + "\nmore") == "\n\nmore"
    # Neighbours of different partners, or far apart in one, are no common block.
    assert left("two words", "and two", "two words\nand two\nmy own") == "two words\nand two\nmy own"
    assert left("two words\nnot this\nand two", "two words\nand two\nmy own") == "two words\nand two\nmy own"


def test_crossing_lines_stay(table):
    a, b, c = "the first long line here", "the second long line here", "the third long line here"
    docs = table([(1, f"{a}\n{b}\n{c}", None), (2, f"{c}\n{a}\n{b}", None)])
    assert {r.doc_id: r.text for r in op.dedup_lines(docs).collect()}[2] == c


def test_a_copy_of_a_later_document_goes_whole(table):
    a, b = "the first long line here", "the second long line here"
    texts = {1: f"{a}\n{b}", 2: f"{b}\n{a}", 3: f"{b}\n{a}"}
    # More copies than a rare line may have holders.
    texts |= {k: texts[2] for k in range(4, 12)}
    # Not a copy, but all its shared lines are those of 2.
    texts[12] = f"{b}\nonly here and nowhere else\n{a}"
    assert removed(table, texts) == brute(texts)


def test_against_brute_force_over_pairs(table):
    rng = random.Random(7)
    texts = {}
    for i in range(20):
        # Lines in another order, each in at most four documents, and copies of a part.
        own = [f"line {i} {j} of a few words" for j in range(8)]
        for k in range(4):
            part = rng.sample(own, rng.randrange(3, 9)) if k < 2 else rng.choice([texts[4 * i], texts[4 * i + 1]]).split("\n")[: rng.randrange(2, 9)]
            texts[4 * i + k] = "\n".join([*part, f"only in {i} {k} and no other"])
    assert removed(table, texts) == brute(texts)


def test_odd_rows(table, odd_rows):
    docs = table(odd_rows)
    found = op.dedup_lines(docs)
    assert found.columns == docs.columns
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in found.collect()))
    prose = odd_rows[0][1]
    want = []
    for i, text, _ in odd_rows:
        # Id 1 comes first; the rows of id 3 are one document, and the null id is last.
        gone = text == prose and i != 1
        want.append((i is None, i or 0, "" if gone else text or ""))
    assert rows == sorted(want)
    assert [r.text for r in found.filter("doc_id = 2").collect()] == [None]
    assert op.dedup_lines(table([])).count() == 0
