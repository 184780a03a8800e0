from collections import Counter

import pytest

from kelpmill.llm import quality

from . import cases


def base(text):
    text = text or ""
    words = text.encode().split()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if x.encode().split()]
    chars = sum(c not in " \t\n\x0b\x0c\r" for c in text)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rows = [tuple(r) for r in cases.documents(spark).collect()]
    rows += [(20 + k, t, None, None, None) for k, t in enumerate(["a b c a b c a", "x\nx\n\n \n \nx y\n", "a a a a", "é ü ß   z", "a b c\na b c"])]
    rows += [(30 + k, " ".join(w + " x y z" for w in cases.alike(k)), None, None, None) for k in (10, 11, 12, 13)]
    rows += [(40 + k, " ".join([*cases.alike(k), "x", *reversed(cases.alike(k)), "x"]), None, None, None) for k in (10, 11, 12, 13)]
    out = quality.judge(cases.documents(spark, rows)).collect()
    for (_, text, *_), r in zip(rows, out, strict=True):
        n, chars, symbols, dups, repeats = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)


@pytest.mark.parametrize("line,fails", [("Home | About | Contact", True), ("All rights reserved.", True), ("It$$$ was### so*** fine&&&", True), ("one two three four five six seven eight nine", True), ("A line that ends as it should, with a full stop.", False), ("Heading", False), ("either | or is fine here, with one bar only.", False)])
def test_lines(line, fails):
    assert quality.line_fails(line) == fails
    assert quality.lines_of(line)[2] == ("" if fails else line)


def test_shortcut_changes_nothing():
    text = "Good line one is here.\n\nHome | About | Contact\nGood line one is here.\n \nno end in this line at all my friend of friends\n{{{ }}}"
    dups, lost, cleaned = quality.lines_of(text)
    assert (dups, cleaned) == (1, "Good line one is here.\n\nGood line one is here.\n ")
    assert lost == sum(quality.word_chars(x) for x in text.split("\n") if quality.word_chars(x) and quality.line_fails(x))


def test_clean(spark):
    good = "\n".join(f"Line w{k} of x{k} that says y{k} after z{k} and u{k} v{k}." for k in range(9))
    rows = [(1, good, "en", "a", len(good)), (2, good + "\nHome | About | Contact", "en", "a", 1), (3, "short.", "en", "a", 6), (4, "\n".join(f"a{k} | b{k} | c{k} | d{k}" for k in range(30)), "en", "a", 6)]
    kept = {r.doc_id: (r.text, r.n_chars) for r in quality.clean(cases.documents(spark, rows)).collect()}
    assert kept == {1: (good, len(good)), 2: (good, len(good))}
    assert quality.clean(cases.clashing(spark)).columns == cases.clashing(spark).columns
    assert quality.judge(cases.clashing(spark)).count() == 11
    assert quality.clean(cases.empty(spark)).count() == 0
