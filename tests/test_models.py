"""Extraction, segmentation, line rules and edits of whole batches against plain models of one text."""

import random
import re
import time

import numpy as np
import pyarrow as pa

from clearprose.config import REGISTERED, LintConfig
from clearprose.functions.table import violations_of
from clearprose.operators import diff, extract, rules, segment
from clearprose.plans.lint import _read

PIECES = ["`", "``", "```", "~~~", "~~~~", "|", "-", "--", ":", " ", "    ", "\t", "é", "x", "a b", "<!--", "-->", "\\", " ", "　", ">", ";"]


def lists(texts):
    return pa.array(texts, pa.list_(pa.string()))


def model_prose(lines):
    """Line by line, with the state of fences and comments."""
    width = lambda s: len(s.encode())
    out, fence, comment = [], None, False
    for line in lines:
        body = line.lstrip()
        indent = width(line) - width(body)
        run = len(body) - len(body.lstrip(body[0])) if body[:1] in ("`", "~") and body else 0
        if indent <= 3 and run >= 3:
            rest = body[run:]
            if fence:
                if body[0] == fence[0] and run >= fence[1] and not rest.strip():
                    fence = None
                line = " " * width(line)
            elif not (body[0] == "`" and "`" in rest):
                fence, line = (body[0], run), " " * width(line)
        elif fence or comment or body.startswith("<!--"):
            if not fence:
                comment = "-->" not in line
            line = " " * width(line)
        elif indent >= 4:
            line = " " * width(line)
        else:
            line = model_spans(line)
        out.append(line)
    blank, i = set(), 0
    row = lambda s: width(s) - width(s.lstrip()) <= 3 and "|" in s
    rule = lambda s: bool(re.fullmatch(r"[|: -]*-[|: -]*", s.strip()))
    while i < len(out):
        if i and rule(out[i]) and row(out[i - 1]):
            blank |= {i - 1, i}
            i += 1
            while i < len(out) and row(out[i]) and not rule(out[i]):
                blank.add(i)
                i += 1
        else:
            i += 1
    return [" " * width(s) if i in blank else s for i, s in enumerate(out)]


def model_spans(line):
    b, i = bytearray(line.encode()), 0
    while i < len(b):
        if b[i] != 96:
            i += 1
            continue
        n = 0
        while i + n < len(b) and b[i + n] == 96:
            n += 1
        if i and b[i - 1] == 92:
            i += 1
            continue
        j = i + n
        while j < len(b):
            m = 0
            while j + m < len(b) and b[j + m] == 96:
                m += 1
            if m == n and b[j - 1] != 92:
                b[i : j + m] = b" " * (j + m - i)
                i = j + m
                break
            j += max(m, 1)
        i += 1
    return b.decode()


def test_cleared_lines_are_the_models():
    rng = random.Random(17)
    texts = [["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 9))] for _ in range(4000)]
    texts += [["| a |", "|---|", "| b |", "c | d", "|-|", "x"], ["a|", "-", "|", "|:-:|", "b"], []]
    got = extract.cleared(lists(texts), np.ones(len(texts), bool)).to_pylist()
    for text, out in zip(texts, got, strict=True):
        assert out == model_prose(text), text


def model_sentences(lines, merge):
    """(line, col, words) of the sentences and (line, sentences) of the paragraphs of a text."""
    width = lambda s: len(s.encode())

    def block(line):
        body = line.lstrip()
        indent = width(line) - width(body)
        if indent > 3 or not body:
            return "N", 0
        solid = "".join(body.split())
        if len(solid) >= 3 and solid[0] in "-_*=" and set(solid) == {solid[0]}:
            return "T", 0
        for kind, pattern in (("N", r">+[ \t]?"), ("S", r"#{1,6}(?:[ \t]|$)"), ("I", r"[-*+][ \t]"), ("I", r"[0-9]{1,9}[.)](?:[ \t]|$)")):
            if m := re.match(pattern, body):
                return kind, indent + m.end()
        return "N", 0

    def ends(s):
        i = 0
        while i < len(s):
            if s[i] in segment.TERMINATORS:
                word = lambda c: c.isascii() and (c.isalnum() or c == "_")
                if s[i] == "." and i and (s[i - 1] in "0123456789" or (word(s[i - 1]) and i + 1 < len(s) and word(s[i + 1]))):
                    i += 1
                    continue
                j = i
                while j < len(s) and s[j] in segment.TERMINATORS:
                    j += 1
                while j < len(s) and s[j] in segment.CLOSERS:
                    j += 1
                if not (s[i] == "!" and i == 1 and s.startswith("#!")):
                    yield j
                i = j
            else:
                i += 1

    found, parts, place = [], [], None

    def close():
        nonlocal parts
        if parts:
            found.append((place[0] + 1, place[1] + 1, len(" ".join(parts).split())))
        parts = []

    for i, line in enumerate(lines):
        kind, start = block(line)
        if not line.strip() or kind == "T":
            close()
            place = None
            continue
        if kind != "N" and parts:
            close()
            place = None
        body = line.encode()[start:].decode()
        if place is None:
            place = (i, start + width(body) - width(body.lstrip()))
        last = 0
        for end in ends(body):
            if body[last:end].strip():
                parts.append(body[last:end].strip())
            place = place or (i, start + width(body[:last]))
            close()
            place, last = None, end
        rest = body[last:]
        if rest.strip():
            place = (i, start + width(body[:last]) + width(rest) - width(rest.lstrip()))
            parts.append(rest.strip())
        if parts and (kind == "S" or not merge):
            close()
            place = None
    if place is not None:
        close()
    para, now, first = [], 0, {}
    for i, line in enumerate(lines):
        if i and (not lines[i - 1].strip() or (line.strip() and block(line)[0] != "N")):
            now += 1
        para.append(now)
        if line.strip():
            first.setdefault(now, i + 1)
    counts = {}
    for line, *_ in found:
        counts[para[line - 1]] = counts.get(para[line - 1], 0) + 1
    return found, [(first[p], n) for p, n in sorted(counts.items())]


def test_sentences_and_paragraphs_are_the_models():
    rng = random.Random(23)
    bits = ["a", "word", "two words", ".", "!", "?", "。", "！", "...", ".)", '."', "”", "»", " ", "  ", "1.", "2)", "3.5", "x.y", "#", "## ", "- ", "* ", "> ", ">>", "---", "***", "===", "é", "　", " ", "#!", "12345678901. ", "e.g. "]
    texts = [["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 8))] for _ in range(6000)]
    for merge in (True, False):
        sentences, paragraphs = segment.segmented(lists(texts), np.full(len(texts), merge))
        for text, s, p in zip(texts, sentences.to_pylist(), paragraphs.to_pylist(), strict=True):
            want, groups = model_sentences(text, merge)
            assert [(x["line"], x["col"], x["word_count"]) for x in s] == want, text
            assert [(x["line"], x["n_sentences"]) for x in p] == groups, text
            assert all(len(x["text"].split()) == x["word_count"] for x in s)


def test_hits_are_those_of_plain_searches():
    rng = random.Random(5)
    bits = ["prior", "prior to", "robust", "Robust", "robustly", "kick off", "don't", "it's", "IT’S", "dog's", "we'll", "a't't", "é", ";", " ", "  ", ", ", "_", "x", "subsequent to", "utilize", "İ"]
    texts = [["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 4))] for _ in range(1500)]
    hits, _ = rules.line_hits(lists(texts), np.ones(len(texts), bool), LintConfig())
    forms = [(r[3], r[0]) for r in rules.dictionary.rows(LintConfig())]
    for text, got in zip(texts, hits.to_pylist(), strict=True):
        want = []
        for no, line in enumerate(text, 1):
            low = line.lower()
            for form, rule in forms:
                for at in range(len(low) - len(form) + 1):
                    sides = low[at - 1 : at] if at else "", low[at + len(form) : at + len(form) + 1]
                    # a dot above, as lower case makes it of a Turkish capital, is no letter
                    if low.startswith(form, at) and not any(c.isalnum() for c in sides):
                        want.append((no, rule, len(low[:at].encode()) + 1))
            want += [(no, "semicolon", len(line[:m.start()].encode()) + 1) for m in re.finditer(";", line)]
            for pattern in (r"\b\w+['’](?:t|re|ve|ll|d|m)\b", rf"\b(?:{'|'.join(rules._CLOSED)})['’]s\b"):
                want += [(no, "contraction", len(line[: m.start()].encode()) + 1) for m in re.finditer(pattern, line.replace("İ", "I"), re.I)] if "İ" not in line else []
        mine = [(h["line"], h["rule_id"], h["col"]) for h in got if h["rule_id"] != "contraction" or "İ" not in text[h["line"] - 1]]
        assert sorted(mine) == sorted(want), text


def test_very_long_texts_take_time_in_proportion():
    took = []
    for n in (20_000, 100_000):
        text = "Tea; don't kick off `a;b` it. " * (n // 10) + "\n" + "; " * n + "\n```\n" + "x\n" * n
        began = time.time()
        found = violations_of(text, "prose-file", LintConfig())
        took.append(time.time() - began)
        assert sum(v[2] == "semicolon" for v in found) == n // 10 + n
    assert took[1] < 12 * max(took[0], 0.3)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_edits_are_shortest():
    rng = random.Random(9)
    for _ in range(1500):
        k = rng.randint(1, 6)
        a, b = ([rng.choice("abcdef"[:k]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        ended = lambda s: [x + "\n" for x in s[:-1]] + s[-1:]
        got, old, new = diff.changed_lines(a, b), ended(a), ended(b)
        assert len(b) - len(got) == longest_common(old, new)
        kept, rest = [x for i, x in enumerate(new) if i + 1 not in got], iter(old)
        assert all(any(x == y for y in rest) for x in kept)
    unlike = diff.changed_lines([f"a{i}" for i in range(20_000)], [f"b{i}" for i in range(20_000)])
    assert unlike == list(range(1, 20_001))
    a = [str(rng.randrange(300)) for _ in range(1500)]
    b = [str(rng.randrange(300)) for _ in range(1500)]
    assert len(b) - len(diff.changed_lines([*a, "end"], [*b, "end"])) == longest_common(a, b)


def test_blank_texts_have_no_sentences():
    """A batch whose lines are all blank, beside texts without lines."""
    for texts in ([["", "  "]], [[], ["\t", ""], []]):
        sentences, paragraphs = segment.segmented(lists(texts), np.full(len(texts), True))
        assert sentences.to_pylist() == paragraphs.to_pylist() == [[] for _ in texts]


def test_only_what_a_rule_reports_leaves_the_evaluation(spark):
    """Long sentences alone, each with what the line before turns off; no paragraphs while their rule is off."""
    long, short = "- " + "word " * 26 + "end.", "Short. One; two."
    texts = [["ste-disable-next-line sentence-length", long, short, "", long], [short] * 9, [], [""]]
    for on, n_paragraphs in (("sentence-length",), [0, 0, 0, 0]), (("sentence-length", "paragraph-length"), [0, 1, 0, 0]):
        config = LintConfig(rules={r: "off" for r in REGISTERED if r not in on}, max_paragraph_sentences=3)
        read = _read(config, False).func(lists(texts), pa.array(["prose-file"] * 4)).to_pylist()
        assert [[(s["line"], s["word_count"], s["hushed"]) for s in d["sentences"]] for d in read] == [[(2, 27, ["sentence-length"]), (5, 27, None)], [], [], []]
        assert [len(d["paragraphs"]) for d in read] == n_paragraphs


def test_directives_are_found_inside_a_line():
    """A name cut by a line's end is none; columns are bytes, and the first name of a line counts."""
    texts = [["é ste-disable-", "next-line", "# ste-disable-next-line bogus ste-disable-next-line", "ste-disable-next-line", "é ste-disable-next-line x"], ["// ste-disable-next-line semicolon"]]
    hits, hushed = rules.line_hits(lists(texts), np.ones(2, bool), LintConfig(rules={r: "off" for r in REGISTERED if r != "invalid-suppression"}))
    assert [[(h["line"], h["col"]) for h in d] for d in hits.to_pylist()] == [[(3, 3), (4, 1)], []]
    assert hushed == {(1, 2): ["semicolon"]}
