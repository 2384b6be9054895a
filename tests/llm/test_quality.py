import collections
import random
import re

from tamiz.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    cover = {j for k in range(len(words) - 7) if seen[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in lines
            lines.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dups,
            "n_repeat_words": len(cover), "base_failed": len(words) < 20 or 100 * len(cover) > 30 * len(words)}


def judged(texts, **limits):
    got = Q.judge(texts, Q.Limits(**limits), True)
    return [{k: v[n] for k, v in got.items()} for n in range(len(texts))]


def test_base_measures_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", "\n\n"] + ["".join(rng.choice(["a ", "b ", "é ", "x\n", "\n", "a b c d e f g h ", "#", "\x1c", "😀\t"]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for text, got in zip(texts, judged(texts)):
        for name, value in base(text).items():
            assert got[name] == value, (name, text)


CLEAN = "This is a plain sentence with quite a few words in it, and nothing is wrong with it at all."


def test_line_rules():
    limits = Q.Limits()
    for line in ("Home | About | News | Contact", "Home About Contact", "Please enable JavaScript to view this page.", "All rights reserved 2024", "*** --- *** ---",
                 "BUY!! NOW!! CHEAP!! PILLS!! HERE!!"):
        assert Q.line_fails(line, limits), line
    for line in (CLEAN, "A title without a stop", "Nie wieder Krieg!", "x = 3 | y", "Is it? It is! Or is it?"):
        assert not Q.line_fails(line, limits), line


def test_documents_that_lose_too_much_are_rejected():
    menu = "\n".join(f"Home | About{k} | News" for k in range(12))
    lines = [" ".join(f"{w}{k}" for w in CLEAN.split()) + "." for k in range(3)]
    good, bad, part = judged(["\n".join(lines), lines[0] + "\n" + menu, "\n".join(lines) + "\nHome | About | News"])
    assert good["kept"] and good["kept_share"] == 1
    assert not bad["kept"] and not bad["base_failed"]
    assert part["kept"] and part["n_lines_removed"] == 1 and "Home" not in part["clean_text"]


def test_edges(edge_docs, edge_rows, no_docs):
    got = Q.quality(edge_docs).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        text = next(t for i, t, *_ in edge_rows if i == r["doc_id"])
        assert {k: r[k] for k in base(text)} == base(text)
        assert not (r["base_failed"] and r["kept"])
    assert Q.quality(no_docs).count() == 0
