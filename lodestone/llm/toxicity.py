"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is a given list plus terms (words, or stems with any ending) learned from labelled documents: those
whose documents are labelled toxic far more often than chance allows (see ``learn``). Its trie is intersected with the
Levenshtein automaton of one edit (terms and stems of at least ``FUZZY_CHARS`` characters; shorter ones match
exactly, and so do a stem's first and last letters), determinised once, and run over all words of a batch at a time. A misspelling that is a word of
non-toxic labelled documents isn't one.

A hit scores 1, each misspelled form once in a document, by its best occurrence. Without ``SAFE_DOCS`` non-toxic labelled
documents nothing tells natural words one edit away from misspellings, which then score ``FUZZY_SCORE``. A hit between quotation marks that pair in its line, or with a reporting
word among the ``CONTEXT`` words before it in its line, is taken as quotation and scores ``QUOTED`` of that; else, with a second
person among the ``CONTEXT`` words on either side, ``DIRECT`` of it. A document is toxic if its scores sum to ``THRESHOLD``.

Defined results: only toxic documents give rows; null and empty texts are never toxic; a null ``doc_id`` is
carried as null; repeated rows are reported each; without labels the given list is the lexicon; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bound_sample
from ._text import codes, pieces, strings

TERMS = ("trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid")
FUZZY_CHARS = 5
FUZZY_SCORE, QUOTED, DIRECT, THRESHOLD = 0.4, 0.2, 1.5, 1.0
CONTEXT = 5
#: At most about so many labelled documents teach the lexicon.
LEARN_BOUND = 12_000
SURE = 1e-4
STEMS = (4, 5, 6, 7)
#: So many non-toxic labelled documents make a safe list on which a misspelling counts as much as its term.
SAFE_DOCS = 100

REPORTING = frozenset("said says say called calls quoted quote quotes wrote writes word words term terms phrase insult insults slur slurs zitat zitierte sagte nannte wort dit appelle citation mot dijo llama palabra cita".split())
SECOND = frozenset("you your youre yours u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre ti usted ustedes vosotros".split())
_OPEN, _CLOSE = "\"'“«‘„‹", "\"'”»’“›"

_IS_WORD = np.zeros(256, bool)
for _c in range(256):
    _IS_WORD[_c] = chr(_c).isalnum() or 128 <= _c < 160
_WORD = re.compile(r"\w+")


class Automaton:
    """The determinised product: ``table[state, class of character]``; ``accept[state]`` = term * 2 + edits, or -1."""

    def __init__(self, terms: list[tuple[str, bool]], fuzzy_chars: int = FUZZY_CHARS):
        self.terms = sorted(set(terms))
        kids: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        room = [-1]  # edits that some term below allows
        for n, (term, stem) in enumerate(self.terms):
            node, k = 0, int(len(term) >= fuzzy_chars)
            room[0] = max(room[0], k)
            for c in codes([term])[0].tolist():
                if c not in kids[node]:
                    kids[node][c] = len(kids)
                    kids.append({})
                    ends.append([])
                    room.append(-1)
                node = kids[node][c]
                room[node] = max(room[node], k)
            ends[node].append(n)
        letters = sorted({c for k in kids for c in k})
        self.classes = np.zeros(256, np.int64)
        self.classes[letters] = np.arange(1, len(letters) + 1)

        def closed(state: dict[int, int]) -> dict[int, int]:
            """With the terms' characters that the text lacks."""
            for node, e in list(state.items()):
                if e == 0 and node >= 0:
                    for kid in kids[node].values():
                        if room[kid] >= 1:
                            state[kid] = min(1 if node else 2, state.get(kid, 9))
            return state

        def step(state: dict[int, int], c: int) -> dict[int, int]:
            out: dict[int, int] = {}

            def add(node, e):
                if node < 0 or room[node] >= min(e, 1):
                    out[node] = min(e, out.get(node, 9))

            for node, e in state.items():
                if node < 0:  # inside a word whose stem has been read
                    add(node, e)
                    continue
                if c in kids[node]:
                    add(kids[node][c], e)
                    for n in ends[kids[node][c]]:  # a stem ends with its own last letter
                        if self.terms[n][1] and (e == 0 or e == 1 and len(self.terms[n][0]) >= fuzzy_chars):
                            add(-1 - n, e)
                if e == 0:  # an edit at the first letter is 2: none for stems
                    for to in (node, *kids[node].values()):
                        add(to, 1 if node else 2)
            return closed(out)

        start = closed({0: 0})
        ids = {frozenset(): 0, frozenset(start.items()): 1}
        states, rows = [{}, start], [[0] * (len(letters) + 1)]
        i = 1
        while i < len(states):
            row = []
            for c in [-1, *letters]:
                to = step(states[i], c)
                key = frozenset(to.items())
                if key not in ids:
                    ids[key] = len(states)
                    states.append(to)
                row.append(ids[key])
            rows.append(row)
            i += 1
        self.table = np.array(rows, np.int32)
        self.accept = np.full(len(states), -1, np.int64)
        for i, state in enumerate(states):
            found = []
            for node, e in state.items():
                if node < 0:
                    found.append((e, -1 - node))
                else:
                    found += [(min(e, 1), n) for n in ends[node] if not self.terms[n][1] and min(e, 1) <= int(len(self.terms[n][0]) >= fuzzy_chars)]
            if found:
                e, n = min(found)
                self.accept[i] = n * 2 + e

    def match(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word index, accept value) of the words ``code[start:end]`` that the lexicon takes."""
        cls = self.classes[code]
        live, state, at = np.arange(len(start)), np.ones(len(start), np.int64), start.copy()
        out_word, out_value = [], []
        while len(live):
            state = self.table[state, cls[at]]
            at = at + 1
            done = at == end[live]
            value = self.accept[state]
            hit = done & (value >= 0)
            out_word.append(live[hit])
            out_value.append(value[hit])
            on = ~done & (state != 0)
            live, state, at = live[on], state[on], at[on]
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, value = np.concatenate(out_word), np.concatenate(out_value)
        order = np.argsort(word)
        return word[order], value[order]


def words_of(texts: list[str]):
    """(code, start, end, row, local start) of all words of lower-cased texts."""
    code, off, _ = codes(texts)
    if not len(code):
        z = np.zeros(0, np.int64)
        return code, z, z, z, z
    own = _IS_WORD[code]
    edge = np.empty(len(code) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(own[1:], own[:-1], out=edge[1:-1])
    edge[off] = True
    cuts = np.flatnonzero(edge)
    use = own[cuts[:-1]]
    start, end = cuts[:-1][use], cuts[1:][use]
    row = np.searchsorted(off, start, "right") - 1
    return code, start, end, row, start - off[row]


def edits_within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def form_of(word: str, term: str, stem: bool) -> str:
    """What of a misspelled word the safe list holds: endings of stems vary."""
    return word[: len(term) + 1] if stem else word


def misspells(word: str, term: str, stem: bool) -> bool:
    """Whether one edit makes ``word`` the term, or a beginning of it the stem, whose first and last letters stand."""
    if not stem:
        return edits_within_one(word, term)
    return word[0] == term[0] and any(w[-1:] == term[-1] and edits_within_one(w, term) for w in (word[: len(term) + d] for d in (-1, 0, 1)))


def enclosed(line: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches of a line between paired quotation marks, apart and in order."""
    spans = []
    for o, c in zip(_OPEN, _CLOSE):
        if o not in line:
            continue
        opens = {'"': r'(?<!\w)"', "'": r"(?<!\w)'(?=\w)"}.get(o, o)
        closes = {'"': r'"(?!\w)', "'": r"(?<=[\w.,!?])'(?!\w)", "’": r"’(?!\w)"}.get(c, c)
        start = None
        for m in re.finditer(f"(?=(?P<o>{opens})?)(?=(?P<c>{closes})?)[{o}{c}]", line):
            if start is not None and m["c"]:
                spans.append((start, m.start()))
                start = None
            elif start is None and m["o"]:
                start = m.end()
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def hits(texts: list[str], automaton: Automaton, safe: frozenset[str], fuzzy: float):
    """(row, misspelled form or None, term, score, quoted) of each hit in lower-cased texts."""
    code, start, end, row, local = words_of(texts)
    word, value = automaton.match(code, start, end)
    newline = np.flatnonzero(code == 10)
    lines: dict[int, tuple[list[int], list[int]]] = {}

    def text_of(j: int) -> str:
        return texts[row[j]][local[j] : local[j] + end[j] - start[j]]

    for w, v in zip(word.tolist(), value.tolist()):
        r, s = int(row[w]), int(local[w])
        e = s + int(end[w] - start[w])
        term, stem = automaton.terms[v // 2]
        mine = texts[r][s:e]
        if v % 2:
            if form_of(mine, term, stem) in safe or not misspells(mine, term, stem):
                continue
            score = fuzzy
        else:
            if not (mine.startswith(term) if stem else mine == term):
                continue
            score = 1.0
        # The line and the whole words around, whatever their lengths; positions are those of the piece.
        i, base = int(np.searchsorted(newline, start[w])), int(start[w]) - s
        lo = max(base, int(newline[i - 1]) + 1 if i else 0)
        if lo not in lines:
            hi = int(newline[i]) - base if i < len(newline) else len(texts[r])
            lines[lo] = enclosed(texts[r][lo - base : hi])
        starts, ends = lines[lo]
        k = bisect_right(starts, int(start[w]) - lo) - 1
        before = [j for j in range(max(0, w - CONTEXT), w) if row[j] == r]
        after = [j for j in range(w + 1, min(len(row), w + 1 + CONTEXT)) if row[j] == r]
        quoted = k >= 0 and int(end[w]) - lo <= ends[k] or any(text_of(j) in REPORTING for j in before if start[j] >= lo)
        if quoted:
            score *= QUOTED
        elif any(text_of(j) in SECOND for j in before + after):
            score *= DIRECT
        yield r, mine if v % 2 else None, term, score, quoted


def learn(docs: DataFrame, labels: DataFrame, known: tuple[str, ...] = TERMS, bound: int = LEARN_BOUND, sure: float = SURE) -> list[tuple[str, bool]]:
    """Words and stems of labelled documents that mark the toxic ones.

    A term with ``a`` toxic of ``n`` documents is taken if at least 95 % are toxic and drawing that many toxic
    ones by chance, among all terms tried, has a probability under ``sure``. Of nested terms with nearly the same
    documents the longest stays. Copies of one document would carry all its words over that mark, so terms are
    then taken one by one, the one in most toxic documents first, while they explain significantly many that hold no
    term taken before (``known`` counts as taken).
    """
    rows = bound_sample(labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")).distinct(), "doc_id", bound)
    sample = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id").select("text", "toxic")

    def count(batches):
        seen: list[Counter] = [Counter(), Counter()]
        for b in batches:
            for text, toxic in zip(strings(b.column(0)).to_pylist(), b.column(1).to_pylist()):
                words = set(_WORD.findall(text.lower()))
                both = {(w, False) for w in words if len(w) >= 3}
                for n in STEMS:
                    both |= {(w[:n], True) for w in words if len(w) > n}
                seen[toxic].update(both)
                seen[toxic][("", False)] += 1
        terms = [t for t in seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms] + [t for t, _ in seen[0]], pa.string()), pa.array([s for _, s in terms] + [s for _, s in seen[0]], pa.bool_()), pa.array([seen[1][t] for t in terms] + [0] * len(seen[0]), pa.int64()), pa.array([0] * len(terms) + list(seen[0].values()), pa.int64())], ["term", "stem", "toxic", "other"])

    found = sample.mapInArrow(count, "term string, stem boolean, toxic long, other long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found = found.where("term = '' or (toxic >= 3 and toxic >= 19 * other)").persist()
    total = found.where("term = ''").first()
    if total is None or not total.toxic or not total.other:
        found.unpersist()
        return []
    rate = total.toxic / (total.toxic + total.other)
    tried = found.count() * 50
    need = math.log(tried / sure) / math.log(1 / rate)
    sound = [(r.term, r.stem, r.toxic) for r in found.where((F.col("term") != "") & (F.col("toxic") - F.col("other") * 3 >= need)).collect()]
    found.unpersist()
    n = {(t, s): a for t, s, a in sound}
    keep = []
    for t, s, a in sound:
        if s and any(len(o) > len(t) and o.startswith(t) and b >= 0.9 * a for (o, _), b in n.items()):
            continue
        keep.append((t, s))
    # The toxic part of the bounded sample, as lists of the terms found sound: small, whatever the corpus.
    words, stems = {t for t, s in keep if not s}, {t for t, s in keep if s}

    def contents(batches):
        for b in batches:
            lists = []
            for text in strings(b.column(0)).to_pylist():
                own = set(_WORD.findall(text.lower()))
                lists.append(sorted({f"w{w}" for w in own & words} | {f"s{w[:n]}" for w in own for n in STEMS if w[:n] in stems and len(w) > n}) if not own & set(known) else [])
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["terms"])

    holders: dict[str, set[int]] = {}
    for i, r in enumerate(sample.where("toxic").select("text").mapInArrow(contents, "terms array<string>").where("size(terms) > 0").collect()):
        for t in r.terms:
            holders.setdefault(t, set()).add(i)
    taken = []
    while holders:
        best = min(holders, key=lambda t: (-len(holders[t]), t))
        covered = holders.pop(best)
        if len(covered) < need:
            break
        taken.append((best[1:], best[0] == "s"))
        holders = {t: d - covered for t, d in holders.items()}
    return sorted(taken)


def natural(docs: DataFrame, labels: DataFrame, automaton: Automaton, bound: int = LEARN_BOUND) -> tuple[frozenset[str], int]:
    """Words one edit from the lexicon that non-toxic labelled documents use, and how many documents those are."""
    rows = bound_sample(labels.where("doc_id is not null and toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", bound)
    sample = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id", "left_semi").select("text")

    def find(batches):
        out: set[str] = set()
        n = 0
        for b in batches:
            n += b.num_rows
            for _, piece in pieces(strings(b.column(0))):
                texts = [t.lower() for t in piece.to_pylist()]
                code, start, end, row, local = words_of(texts)
                word, value = automaton.match(code, start, end)
                for w, v in zip(word.tolist(), value.tolist()):
                    if v % 2:
                        s = int(local[w])
                        out.add(form_of(texts[row[w]][s : s + int(end[w] - start[w])], *automaton.terms[v // 2]))
        yield pa.RecordBatch.from_arrays([pa.array([None, *sorted(out)], pa.string()), pa.array([n] + [0] * len(out), pa.int64())], ["word", "n"])

    found = sample.mapInArrow(find, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return frozenset(r.word for r in found if r.word is not None), sum(r.n for r in found)


def toxic_documents(docs: DataFrame, labels: DataFrame | None = None, terms: tuple[str, ...] = TERMS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, n_hits, n_quoted, terms) of toxic documents."""
    lexicon = [(t, False) for t in terms]
    if labels is not None:
        lexicon += learn(docs, labels, terms)
    automaton = Automaton(lexicon)
    safe, n_safe = natural(docs, labels, automaton) if labels is not None else (frozenset(), 0)
    fuzzy = 1.0 if n_safe >= SAFE_DOCS else FUZZY_SCORE
    held = docs.sparkSession.sparkContext.broadcast((automaton, safe))

    def find(batches):
        automaton, safe = held.value
        for b in batches:
            per: dict[int, list] = {}
            best: dict[tuple[int, str], int] = {}
            for at, piece in pieces(strings(b.column(1)), 1 << 19):
                for row, form, term, score, quoted in hits([t.lower() for t in piece.to_pylist()], automaton, safe, fuzzy):
                    own = per.setdefault(at + row, [])
                    n = len(own) if form is None else best.setdefault((at + row, form), len(own))
                    if n == len(own):
                        own.append((term, score, quoted))
                    elif score > own[n][1]:
                        own[n] = term, score, quoted
            per = {r: h for r, h in per.items() if round(sum(s for _, s, _ in h), 6) >= threshold}
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(list(per), pa.int64())),
                    pa.array([round(sum(s for _, s, _ in h), 6) for h in per.values()], pa.float64()),
                    pa.array([len(h) for h in per.values()], pa.int64()),
                    pa.array([sum(q for _, _, q in h) for h in per.values()], pa.int64()),
                    pa.array([sorted({t for t, _, _ in h}) for h in per.values()], pa.list_(pa.string())),
                ],
                ["doc_id", "score", "n_hits", "n_quoted", "terms"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, "doc_id long, score double, n_hits long, n_quoted long, terms array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
