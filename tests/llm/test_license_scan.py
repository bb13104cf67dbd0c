"""License scans against brute force over all windows, and their edge cases."""

import math
import random
import re
from collections import Counter

from severa.llm import license_texts
from severa.llm.license_scan import scan_licenses
from severa.llm.license_texts import TEMPLATES

MIT, APACHE, GPL = TEMPLATES["MIT"][0], TEMPLATES["Apache-2.0"][0], TEMPLATES["GPL-3.0"][0]
PROSE = "the river town keeps a market every week where people trade bread cloth and old songs without any hurry at all".split()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute(texts, templates, least):
    """The licence and rounded cosine of every text."""
    known = [(name, words(t)) for name, ts in sorted(templates.items()) for t in ts]
    vocab = {w for _, t in known for w in t}
    df = Counter(w for x in texts for w in set(words(x)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + (df[w] if w in vocab else 1))) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for text in texts:
        ws, best = words(text), []
        for name, t in known:
            tv, n = vector(t), len(t)
            step = max(1, n // 8) if n >= 16 else 1
            starts = sorted({*range(0, len(ws) - n + 1, step), max(0, len(ws) - n)})
            units = [ws, *(ws[i : i + n] for i in starts)] if ws else []
            c = max((sum(x * tv.get(w, 0) for w, x in u.items()) / norm(u) / norm(tv) for u in map(vector, units)), default=0)
            if round(c, 6) >= least:
                best.append((-round(round(c, 6) * n, 6), name, round(c, 6)))
        best = min(best, default=(0, None, None))
        out.append((best[1], best[2]))
    return out


def wrapped(text, width, lead="# "):
    w = text.split()
    return "\n".join(lead + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_same_as_brute_force(spark):
    rnd = random.Random(7)
    prose = lambda n: " ".join(rnd.choice(PROSE) for _ in range(n))
    all_texts = [t for ts in TEMPLATES.values() for t in ts]
    texts = [prose(rnd.randint(0, 200)) for _ in range(20)] + [f"{prose(rnd.randint(0, 90))}\n{wrapped(t, rnd.randint(4, 11))}\n{prose(rnd.randint(0, 90))}" for t in all_texts]
    texts += [" ".join(w for w in t.split() if rnd.random() > 0.1) for t in all_texts] + [None, "", "?!"]
    files = spark.createDataFrame([(i, "r", f"d{i}/f", t) for i, t in enumerate(texts)], "i int, repo string, path string, text string").repartition(5)
    got = {r.file.i: (r.own, r.cosine) for r in scan_licenses(files).collect()}
    want = brute(texts, TEMPLATES, 0.75)
    assert [got[i][0] for i in range(len(texts))] == [w[0] for w in want]
    assert all(w[1] is None or abs(got[i][1] - w[1]) < 2e-6 for i, w in enumerate(want))
    named = [n for n, ts in TEMPLATES.items() for _ in ts]
    assert sum(got[20 + i][0] == n for i, n in enumerate(named)) >= len(named) - 1  # the GPL's versions differ by a word


def test_whole_files_headers_and_inheritance(spark):
    rows = [
        ("r", "LICENSE", f"Copyright (c) 2020 Harbor Foods\n\n{wrapped(MIT, 9, '')}", 1),
        ("r", "a/f.txt", "nothing", 2),
        ("r", "a/b/LICENSE.md", f"{APACHE} All rights reserved", 3),
        ("r", "a/b/c/g.txt", None, 4),
        ("r", "a/h.py", wrapped(GPL, 7), 5),
        ("s", "f.txt", "licensed meals", 6),
        (None, None, "text\nReleased under the MIT License.\nmore", 7),
        ("r", "a/b/COPYING", "Released under the MIT License.", 8),
        ("r", "a/f.txt", "nothing", 2),
        ("r", "z/long.txt", "word " * 60_000 + wrapped(APACHE, 6) + " word" * 60_000, 9),
    ]
    files = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "repo string, path string, text string, row int, own string, cosine double")
    got = Counter((r.file.row, r.own, r.inherited, r.from_dir, r.license) for r in scan_licenses(files).collect())
    assert got == Counter({
        (1, "MIT", "MIT", "", "MIT"): 1, (2, None, "MIT", "", "MIT"): 2, (3, "Apache-2.0", "Apache-2.0", "a/b", "Apache-2.0"): 1, (4, None, "Apache-2.0", "a/b", "Apache-2.0"): 1, (5, "GPL-3.0", "MIT", "", "GPL-3.0"): 1,
        (6, None, None, None, None): 1, (7, "MIT", None, None, "MIT"): 1, (8, "MIT", "Apache-2.0", "a/b", "MIT"): 1, (9, "Apache-2.0", "MIT", "", "Apache-2.0"): 1,
    })
    assert scan_licenses(files.limit(0)).count() == 0


def test_ties_go_to_the_smallest_name(spark):
    files = spark.createDataFrame([("r", "f", "red green blue")], "repo string, path string, text string")
    assert scan_licenses(files, {"b": ("red green blue",), "a": ("blue green red",)}).first().own == "a"


def test_templates_are_told_apart():
    assert len({t for ts in license_texts.TEMPLATES.values() for t in ts}) == sum(map(len, TEMPLATES.values()))
