import random
import re
from collections import Counter
from itertools import groupby

import pytest

from lodescan.llm import line_rules as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    found = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(8)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice,
            len(covered), failed)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def compare(docs):
    ours = sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in COLUMNS])
                  for r in L.line_rules(docs).collect())
    theirs = sorted((r["doc_id"] is None, r["doc_id"] or 0, *base(r["text"])) for r in docs.collect())
    assert ours == theirs


def test_generated_documents(small):
    compare(small)


def test_odd_documents(docs, no_docs):
    compare(docs)
    assert L.line_rules(no_docs).collect() == []


MARKS = ".!?…:;。！？：；؟؛۔।॥։።፧၊။។" + "".join(map(chr, range(0xE00, 0xF00)))


def fails(line):
    """The line rules once more, on characters and words instead of patterns."""
    words = line.count(" ") + 1
    noise = sum(len(list(run)) > 1 for key, run in groupby(line) if key in "!?")
    noise += sum(on for on, _ in groupby(line, key=lambda c: c in "#*$%&<>"))
    bars = sum(map(line.count, "|»›•·"))
    stock, at, low = 0, 0, line.lower()
    while at < len(low):
        found = next((p for p in L.PHRASES if low.startswith(p, at) and not (
            edge(low[at - 1:at]) or edge(low[at + len(p):at + len(p) + 1]))), "")
        stock += len(found)
        at += len(found) or 1
    return (2 * noise > words or (bars >= 3 and 4 * bars > words)
            or (words >= 20 and not set(MARKS) & set(line))
            or (len(line) <= 200 and 0 < stock and 5 * stock >= len(line)))


def edge(c):
    return c.isascii() and (c.isalnum() or c == "_")


def verdict(text):
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    clean = [line for line in lines if not fails(line)]
    left, whole = (sum(map(len, WORD.findall("\n".join(x)))) for x in (clean, lines))
    return len(clean), not base(text)[-1] and 2 * (whole - left) <= whole


def compare_verdicts(docs):
    ours = sorted((str(r["doc_id"]), r["n_clean_lines"], r["kept"]) for r in L.line_rules(docs).collect())
    assert ours == sorted((str(r["doc_id"]), *verdict(r["text"])) for r in docs.collect())


def test_verdicts_of_generated_documents(small):
    compare_verdicts(small)


def test_verdicts_of_odd_lines(spark):
    draw = random.Random(11)
    parts = ["word", "catalog in", "log in", "Subscribe", "JavaScript", "|", "»", "!!", "???", "#*", "$", "a.", "है।",
             "سؤال؟", "ไทย", "All rights reserved", "read morex", "x_sign up", "éread more", "old mill", "stood by"]
    texts = ["\n".join(" ".join(draw.choices(parts, k=draw.randint(1, 30))) for _ in range(draw.randint(1, 6)))
             for _ in range(400)]
    compare_verdicts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


SENTENCE = "This is an ordinary sentence that a person wrote about the weather today."
OTHER = "Nobody in our small town could remember when the old mill had stopped turning."
THIRD = "She counted boats from her window until rain hid the far side of the bay."


@pytest.mark.parametrize("text, kept, clean", [
    ("\n".join([SENTENCE, OTHER, THIRD]), True, 3),
    ("Home | News | Sport | Contact | About\n" + SENTENCE + "\n" + OTHER, True, 2),
    ("Home | News | Sport | Contact | About | Help | Terms | Jobs | Press | Blog | Shop | Map | Login", False, 0),
    ("Word*** other### more%%% again&&& still$$$ word*** next### last%%% first&&& then$$$ "
     "some*** few### many%%% old&&& new$$$ red*** blue### green%%% cold&&& warm$$$ end.", False, 0),
    ("THIS!! IS!! A!! VERY!! LOUD!! TEXT!! THAT!! NOBODY!! WANTS!! TO!! READ!! OR!! KEEP!! IN!! "
     "ANY!! USEFUL!! CORPUS!! OF!! GOOD!! WRITING!! TODAY!!", False, 0),
    (SENTENCE + "\nAll rights reserved.\n" + THIRD, True, 2),
    (" ".join(f"word{i}" for i in range(40)), False, 0),
    ("The museum keeps a full catalog in the reading room, and every visitor who asks the warden may turn its pages at leisure.", True, 1),
    ("Most programs of that kind were written in JavaScript, though the older members of the group still preferred the languages of their youth.", True, 1),
    (" ".join(f"शब्द{i}" for i in range(30)) + " है।", True, 1),
    (" ".join(f"كلمة{i}" for i in range(30)) + "؟", True, 1),
])
def test_lines_decide(spark, text, kept, clean):
    row = L.line_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["kept"], row["n_clean_lines"]) == (kept, clean)
    assert len([x for x in row["clean_text"].split("\n") if x]) == clean
