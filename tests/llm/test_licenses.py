"""License scans against a plain edit distance over all runs of words, and notices that are easy to confuse."""

import pytest

from quillon.llm import licenses, queries
from quillon.llm.common import table

TINY = "/root/testdata/sf0.001"


def scan(text):
    names = [x.split()[0] for x in ("n_words n_base first_word last_word base_labels labels score spans").split()]
    return dict(zip(names, licenses.scan(text.encode(), licenses.PHRASES, licenses.NOTICES), strict=True))


def distances(a, text, most):
    """Edit distance of a to each prefix of text, up to most edits longer than a."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def least(notice, words, at, k):
    """The fewest edits, up to k, of the notice over runs of words that begin at at; None if there are more."""
    parts, told = [], None
    for w in notice.split():
        own = w in licenses.TELLING or w.isdigit()
        if own == told:
            parts[-1][1].append(w)
        else:
            parts.append((own, [w]))
        told = own
    states = {at: 0}
    for own, part in parts:
        onward = {}
        for start, edits in states.items():
            if own:
                if words[start : start + len(part)] == part:
                    onward[start + len(part)] = min(edits, onward.get(start + len(part), k + 1))
                continue
            rest = " ".join(words[start : start + len(part) + k + 1])[: len(" ".join(part)) + k + 1]
            row = distances(" ".join(part), rest, k)
            end, n = 0, start
            for w in words[start : start + len(part) + k + 1]:
                end += len(w) + (end > 0)
                n += 1
                if end < len(row) and edits + row[end] <= k:
                    onward[n] = min(edits + row[end], onward.get(n, k + 1))
        states = onward
    return min(states.values(), default=None)


def plain(text):
    """(base columns, labels that notices give, best similarity)"""
    words = [w.decode() for w in licenses.words_of(text.encode())]
    joined = " " + " ".join(words) + " "
    starts = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found = {}
    for notice, label in licenses.NOTICES.items():
        told = [w for w in notice.split() if w in licenses.TELLING or w.isdigit()]
        if all(f" {w} " in joined for w in told):
            k = len(notice) // licenses.PER_EDIT
            first = notice.split()[0]
            for at, w in enumerate(words):
                if told or min(distances(first, w, k)) <= k:
                    if (edits := least(notice, words, at, k)) is not None:
                        found[notice] = max(found.get(notice, 0), 1 - edits / len(notice))
    return len(words), len(starts), {x for _, x in starts}, found


def test_scan_of_a_table_equals_a_plain_edit_distance(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, TINY, "documents").collect()}
    some = 0
    for r in queries.op7_license_scan(spark, TINY).collect():
        n_words, n_base, base, notices = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n_words, n_base, ",".join(sorted(base)))
        assert r["score"] == pytest.approx(max([1.0 if base else 0.0, *notices.values()]))
        labels = set(r["labels"].split(",")) - {""}
        assert base <= labels <= base | {licenses.NOTICES[x] for x in notices}
        assert all(x["label"] in labels for x in r["spans"]) and bool(r["spans"]) == bool(notices)
        some += bool(notices)
    assert some


@pytest.mark.parametrize(("text", "labels", "spans"), [
    ("released under teh mit license released under the mit license", "mit", [(0, 5), (5, 10)]),
    ("licensed under CC BY 4.0", "cc-by", [(0, 4)]),
    ("licensed under cc by nd 4.0", "cc-by,cc-by-nd", [(0, 5)]),
    ("Apache License Version 1.1", "apache-1.1", [(0, 5)]),
    ("small rights reserved", "", []),
    ("licensed undr the Apache Licence, Version 2.0", "apache-2.0", [(3, 8)]),
    ("released under the mid license", "", []),
    ("licenced under cc by nc sa", "cc-by,cc-by-nc-sa", [(0, 6)]),
    ("the gnu lesser general public licence", "lgpl", [(1, 6)]),
])
def test_notices_that_are_easy_to_confuse(text, labels, spans):
    found = scan(text)
    assert found["labels"] == labels and [(x["first_word"], x["end_word"]) for x in found["spans"]] == spans


def test_made_up_notices_equal_a_plain_edit_distance():
    import random

    rng = random.Random(17)
    notices = list(licenses.NOTICES)
    for _ in range(300):
        out = []
        for _ in range(rng.randrange(1, 4)):
            text = list(rng.choice(notices))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(text))
                text[at] = rng.choice(["", "x", text[at] + "y", " ", text[at]])
            out += [rng.choice(["", "some words", "all", "by"]), "".join(text)]
        text = " ".join(out)
        _, _, base, found = plain(text)
        got = scan(text)
        assert got["score"] == pytest.approx(max([1.0 if base else 0.0, *found.values()])), text
        assert bool(got["spans"]) == bool(found), text
