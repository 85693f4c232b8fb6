"""Brute force, planted cases, and defined results on messy input for the ten operators."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import _tokens, decontam, lines, minhash, packing, quality_classifier, quality_rules, secrets, sharding, token_counts, toxicity

from .helpers import docs, labels, messy, prose


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- 1 secrets
def test_secrets_found_and_known_shapes_left(spark):
    key, digest = "9aQw3ErTy7UiOpLkJhGfDsAzXcVbNm12", "839756d1d951091d9155cd2a457ceedd23acaf1e"
    text = f'né key {key} sha1 {digest} token = "{digest}" id 550e8400-e29b-41d4-a716-446655440000 card 4279055890764913 internationalizationwords'
    got = secrets.secret_scan(docs(spark, [(1, text)])).orderBy("start").collect()
    assert [(r.start, r.n_chars, r.named) for r in got] == [(text.index(key), 32, False), (text.rindex(digest), 40, True)]
    assert secrets.excluded(digest.encode(), b"commit ", b"", False) == "digest"


def test_secrets_messy(spark):
    assert rows(secrets.secret_scan(messy(spark))) == []
    assert rows(secrets.secret_scan(docs(spark, []))) == []
    two = secrets.secret_scan(docs(spark, [(1, "password=e3b3ed3cc8548923d6")] * 2))
    assert two.count() == 2


def test_secrets_equal_brute_force(spark):
    """The rules one character at a time, on texts of random parts."""
    rng = random.Random(12)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    parts = [lambda: key(rng.randrange(8, 50)), lambda: "%040x" % rng.getrandbits(160), lambda: prose(rng.randrange(999), 3), lambda: rng.choice(["password=", "token: ", 'api_key="', "é", "“", "https://x.org/a?b=", " ", "\n", "me@site.org/", "==", "www.", "authors "]), lambda: str(rng.getrandbits(60)), lambda: "550e8400-e29b-41d4-a716-446655440000"]
    texts = [(i, "".join(rng.choice(parts)() + rng.choice(["", " ", ".", '"']) for _ in range(25))) for i in range(60)]
    enc = _tokens.encoder().encode_ordinary
    want = []
    for i, t in texts:
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", t):
            run, s = m[0], m.start()
            named = re.search(secrets.NAME.pattern + rb"[^A-Za-z0-9_]{0,5}$", t[:s].encode(), re.I)
            if len(run) < (secrets.NAMED_CHARS if named else secrets.MIN_CHARS):
                continue
            mixed = any(c.isdigit() for c in run) or sum(c.isupper() for c in run) > 1 and any(c.islower() for c in run)
            if not named and not mixed:
                continue
            e = m.end()
            while t[e : e + 1] == "=":
                e += 1
            run = t[s:e]
            token = re.search(r"[^ \n\t\r\f\v]*$", t[:s])[0] + run + re.match(r"[^ \n\t\r\f\v]*", t[e:])[0]
            if not named:
                if run.isdigit() or secrets.UUID.match(run.encode()) or re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) and len(run) in secrets.DIGEST_CHARS:
                    continue
                if any(secrets.in_word(c) for c in (t[s - 1 : s], t[e : e + 1])) or "://" in token or re.match(r"[^@]*@[A-Za-z0-9_-]+\.", token) or token.startswith("www."):
                    continue
            if len(run) <= secrets.MAX_RATIO * len(enc(run)):
                want.append((i, s, len(run), bool(named)))
    got = sorted((r.doc_id, r.start, r.n_chars, r.named) for r in secrets.secret_scan(docs(spark, texts)).collect())
    assert got == sorted(want) and len(want) > 50


def test_secrets_link_of_any_length(spark):
    key, far = "9aQw3ErTy7UiOpLkJhGfDsAzXcVbNm12", "&".join(f"p{i}=v" for i in range(40))
    assert rows(secrets.secret_scan(docs(spark, [(1, f"https://x.org/?{far}&k={key}")]))) == []


def test_secrets_named_without_digits_and_beside_punctuation(spark):
    lower, short, key = "qzjxkvwqpbzhxgfkjvtq", "k9Zq3xW7v", "9aQw3ErTy7UiOpLkJhGfDsAzXcVbNm12"
    texts = [(1, f"password={lower}"), (2, f"pwd: {short}"), (3, f"“{key}”"), (4, f"«{key}»"), (5, f"{key}—"), (6, f"é{key}"), (7, f"x {lower} {short}"), (8, "password=international token is secret authentication")]
    got = secrets.secret_scan(docs(spark, texts)).collect()
    assert {r.doc_id: r.n_chars for r in got} == {1: 20, 2: 9, 3: 32, 4: 32, 5: 32} and len(got) == 5


# ---- 2 lines
def runs_by_brute_force(texts):
    """The words of each run of covered lines, by document: lines that a run shared with an earlier text covers, by comparing every pair of texts."""
    every = {i: lines.Lines(pa.array([t], pa.large_string())) for i, t in texts}
    hashes = {i: l.hash.tolist() for i, l in every.items()}
    where = collections.defaultdict(list)
    for i, hs in hashes.items():
        for p, h in enumerate(hs):
            where[h].append((i, p))
    out = collections.defaultdict(set)
    for b, hb in hashes.items():
        for p, h in enumerate(hb):
            for a, q in where[h]:
                ha, n = hashes[a], 0
                if a >= b or p and q and hb[p - 1] == ha[q - 1]:  # part of a longer run
                    continue
                while p + n < len(hb) and q + n < len(ha) and hb[p + n] == ha[q + n]:
                    n += 1
                if n >= lines.WINDOW or int(every[b].words[p : p + n].sum()) >= lines.MIN_WORDS:
                    out[b] |= set(range(p, p + n))
    runs = {}
    for b, ls in out.items():
        runs[b] = []
        for i in sorted(ls):
            if i - 1 not in ls:
                runs[b].append(0)
            runs[b][-1] += int(every[b].words[i])
    return runs


def deleted_by_brute_force(texts):
    """How many words lie in covered lines."""
    return {b: sum(n) for b, n in runs_by_brute_force(texts).items()}


def test_line_dedup_deletes_shared_passages(spark):
    passage = prose(7, 70)
    texts = [(1, prose(1) + " " + passage + " " + prose(2)), (2, prose(3) + " " + passage + "\n" + prose(4)), (3, prose(5)), (4, passage)]
    got = {r.doc_id: r for r in lines.line_dedup(docs(spark, texts)).collect()}
    want = deleted_by_brute_force(texts)
    assert {i: r.words_deleted for i, r in got.items() if r.words_deleted} == want and set(want) == {2, 4}
    assert got[1].text == texts[0][1] and got[3].text == texts[2][1]
    middle = " ".join(passage.split()[20:50])
    assert middle not in got[2].text and prose(3)[:200] in got[2].text and prose(4)[-200:] in got[2].text


def test_line_dedup_matches_every_earlier_occurrence(spark):
    """Neither the first nor the preceding occurrence of the common short line has the neighbours of the copy."""
    r = random.Random(11)
    hashes = lambda t: lines.Lines(pa.array([t], pa.large_string())).hash.tolist()
    common = min((f"w{i}" for i in range(500)), key=lambda w: hashes(w)[0])
    every = (" ".join(r.choice("abcdefghij") + str(r.randrange(10**6)) for _ in range(4)) for _ in range(10**4))
    some = (t for t in every if len(h := hashes(t)) == 1 and h[0] > hashes(common)[0])
    line = lambda: next(some)
    passage = [line() for _ in range(13)]
    passage[2::3] = [common] * 4
    text = lambda ls: "\n".join(ls)
    around = lambda: text([line(), line(), common, line(), line()])
    texts = [(1, around()), (2, text(passage)), (3, around()), (4, text([line(), *passage, line()]))]
    got = {x.doc_id: x for x in lines.line_dedup(docs(spark, texts)).collect()}
    assert {i: x.words_deleted for i, x in got.items() if x.words_deleted} == deleted_by_brute_force(texts)
    assert got[4].words_deleted == len(text(passage).split())


def test_line_dedup_isolated_lines_hide_no_run(spark):
    """A run's lines that occur singly in earlier and in between texts, and a text that two others cover only together."""
    r = random.Random(4)
    line = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(10**6)) for _ in range(n))
    run = [line(5) for _ in range(14)]
    alone = lambda: "\n".join(x for y in run for x in (line(4), y, line(4)))
    texts = [(1, alone()), (2, "\n".join(run)), (3, alone()), (4, "\n".join(run))]
    got = {x.doc_id: x.words_deleted for x in lines.line_dedup(docs(spark, texts)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 70}
    few = lambda: next(t for t in iter(lambda: line(10), None) if len(lines.Lines(pa.array([t], pa.large_string())).hash) == 1)
    a, m, b = few(), few(), few()
    texts = [(1, f"{a}\n{m}"), (2, f"{m}\n{b}"), (3, f"{a}\n{m}\n{b}")]
    assert deleted_by_brute_force(texts) == {} and all(x.words_deleted == 0 for x in lines.line_dedup(docs(spark, texts)).collect())


@pytest.mark.parametrize("heat", ["none", "some", "all"])
def test_line_dedup_equals_brute_force_on_random_corpora(spark, heat):
    """Few distinct lines, so that every line recurs singly and in runs; which lines count as hot changes nothing."""
    r = random.Random(8)
    line = lambda i: f"w{i} x{i * 7} y{i * 13}"
    texts = []
    for d in range(40):
        body = [line(r.randrange(60)) for _ in range(r.randrange(3, 25))]
        if d % 3 == 2:
            src = texts[r.randrange(len(texts))][1].split("\n")
            at = r.randrange(len(src))
            body[len(body) // 2 :] = src[at : at + r.randrange(3, 12)]
        texts.append((d, "\n".join(body)))
    every = np.unique(np.concatenate([lines.Lines(pa.array([t], pa.large_string())).hash for _, t in texts])).view(np.int64)
    hot = {"none": every[:0], "some": every[::2], "all": every}[heat]
    got = {x.doc_id: x.words_deleted for x in lines.line_dedup(docs(spark, texts), min_words=1, hot=hot).collect()}
    by = {i: lines.Lines(pa.array([t], pa.large_string())) for i, t in texts}
    want = {}
    for i, t in by.items():  # every shared window of lines, and single lines and pairs, since one word is enough
        seen = set()
        for j in (j for j in by if j < i):
            seen |= set(by[j].hash.tolist())
        want[i] = [h in seen for h in t.hash.tolist()]
        inside = {}
        for k, h in enumerate(t.hash.tolist()):
            want[i][k] |= h in inside
            inside[h] = k
    # Fingerprints decide where single lines are found: what is deleted is shared, and all runs of three lines are.
    three = {}
    for i, t in by.items():
        h, mark = t.hash.tolist(), [False] * len(t.hash)
        for k in range(len(h) - 2):
            if tuple(h[k : k + 3]) in three:
                mark[k : k + 3] = [True] * 3
            three.setdefault(tuple(h[k : k + 3]), (i, k))
        low, high = (sum(int(w) for w, m in zip(t.words, ms) if m) for ms in (mark, want[i]))
        assert low <= got[i] <= high
    assert sum(got.values()) > 100
    same = {x.doc_id: x.words_deleted for x in lines.line_dedup(docs(spark, texts), min_words=1, hot=every[:0]).collect()}
    assert got == same


def test_line_dedup_names_hot_lines(spark):
    texts = [(i, f"{prose(i, 6)}\nshared line of many\n{prose(i + 999, 6)}") for i in range(300)]
    key = docs(spark, texts).select("doc_id", "text", lines.tag_of("text").alias("tag"))
    hot = lines.hot_lines(key, rows=150, sample=1)
    assert set(hot.tolist()) <= set(lines.Lines(pa.array(["shared line of many"], pa.large_string())).hash.view(np.int64).tolist()) and len(lines.hot_lines(key)) == 0


def test_stumps_of_near_copies_go(spark):
    base = prose(31, 200).split()
    near = list(base)
    near[20], near[150] = "alpha", "beta"
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, prose(32, 150) + " " + " ".join(base[40:100]))]
    assert {r.doc_id for r in lines.without_repeats(docs(spark, texts)).collect()} == {1, 3}


def test_line_dedup_messy(spark):
    got = rows(lines.line_dedup(messy(spark)).select("doc_id", "text", "words_deleted"))
    by = collections.defaultdict(list)
    for i, t, n in got:
        by[i].append((t, n))
    assert by[1] == [(None, 0)] and by[2] == [("", 0)] and by[None] == [(prose(1), 0)]
    assert [n for _, n in by[5]] == [0, 0] and by[6] == [("", 60)]
    kept = lines.without_repeats(messy(spark))
    assert kept.columns == messy(spark).columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7, 8}
    assert lines.line_dedup(docs(spark, [])).count() == 0


# ---- 3 quality rules
def test_quality_rules_by_hand(spark):
    texts = [(i, prose(i)) for i in range(20)] + [(100 + i, "the *** !! " * 20) for i in range(5)]
    d, l = docs(spark, texts), labels(spark, [(i, 1, 0) for i in range(10)])
    got = {r.doc_id: r for r in quality_rules.quality_rules(d, l, threshold=-0.05).collect()}

    def grams(t):
        doc, cell = quality_rules.gram_cells(pa.array([t.lower()], pa.large_string()))
        assert len(cell) == 2 * len(re.findall(r"\w+|[^\w\s]+", t)) - 1
        return collections.Counter(cell.tolist())

    raw, target = collections.Counter(), collections.Counter()
    for i, t in texts:
        raw.update(grams(t))
        if i < 10:
            target.update(grams(t))
    b = quality_rules.BUCKETS
    for i, t in texts:
        g = grams(t)
        s = sum(n * math.log((target[c] / (raw[c] / raw.total()) + b) / (target.total() + b)) for c, n in g.items()) / g.total()
        assert abs(got[i].score - s) < 1e-8 and got[i].keep == (s >= -0.05) and got[i].keep == (i < 100)


def test_quality_rules_messy(spark):
    got = rows(quality_rules.quality_rules(messy(spark), labels(spark, [(5, 1, 0)])).select("doc_id", "score", "keep"))
    assert len(got) == 10 and all((s is None) == (i in (1, 2, 3)) and (k is False or s is not None) for i, s, k in got)
    kept = quality_rules.keep_good(messy(spark), labels(spark))
    assert kept.count() == 7 and kept.columns == messy(spark).columns
    assert quality_rules.quality_rules(docs(spark, []), labels(spark)).count() == 0


# ---- 4 toxicity
def test_automaton_equals_edit_distance():
    terms = ["idiot", "clown", "scum", "trash"]
    a = toxicity.Automaton([(t, False) for t in terms] + [("lowei", True)])
    rng = random.Random(3)
    pool = {*terms, "lowei", "loweichen", "lowe", "xlowei"}
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "x", "t"])
            pool.add("".join(w) or "q")

    def distance(x, y):
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            p, d[0] = d[0], i
            for j, e in enumerate(y, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (c != e))
        return d[-1]

    for w in sorted(pool):
        code, start, end, _, _ = toxicity.words_of([w])
        hit = a.match(code, start, end)[1]
        best = min([(distance(w, t)) for t in terms if distance(w, t) <= (1 if len(t) >= toxicity.FUZZY_CHARS else 0)] + ([0] if w.startswith("lowei") else []), default=None)
        assert (None if not len(hit) else int(hit[0]) % 2) == best, w


def test_toxicity_contexts(spark):
    texts = [(1, "what a worthless fool"), (2, 'she called him "worthless" yesterday'), (3, "you idiut, you morron clwn"), (7, "moon moon moon moon moon moon"), (4, prose(1)), (5, "the loweichen und"), (6, "wortless lamp")]
    assert {r.doc_id for r in toxicity.toxic_documents(docs(spark, texts)).collect()} == {1, 3}


def test_toxicity_learns_stems_and_spares_natural_words(spark):
    texts = [(i, prose(i) + f" blorg{'abcdefgh'[i % 8]}x") for i in range(60)] + [(100 + i, prose(i, 40) + " idiott") for i in range(200)]
    l = labels(spark, [(i, 1, int(i < 60)) for i, _ in texts])
    assert toxicity.learn(docs(spark, texts), l) == [("blorg", True)]
    assert {r.doc_id for r in toxicity.toxic_documents(docs(spark, texts), l).collect()} == set(range(60))


def test_toxicity_misspelled_stems():
    a = toxicity.Automaton([("réeux", True), ("bomente", True)])

    def found(word, safe=frozenset()):
        return [(term, form) for _, form, term, *_ in toxicity.hits([word], a, safe, 1.0)]

    assert all(found(w) for w in ("bomentes", "bomxentes", "bomntes", "bxmentes", "réxuxen"))
    assert not any(found(w) for w in ("bxmxntes", "xbomentes", "boment", "réeu", "moment"))
    assert not found("bomxentes", frozenset({"bomxente"})) and not found("bomxenterie", frozenset({"bomxente"}))


def test_toxicity_misspelling_alone_by_its_best_occurrence(spark):
    clean = [(1000 + i, prose(i)) for i in range(toxicity.SAFE_DOCS)]
    texts = [(1, "you idiiot"), (2, "idiiot " * 50), (3, 'she wrote "idiiot" and then shouted at length: such an idiiot'), (4, 'he said "idiiot"'), *clean]
    got = toxicity.toxic_documents(docs(spark, texts), labels(spark, [(i, 1, 0) for i, _ in clean]))
    assert {r.doc_id: r.n_hits for r in got.collect()} == {1: 1, 2: 1, 3: 1}


def test_toxicity_quotation_marks_pair_over_the_line(spark):
    far = "river stone lamp " * 12
    texts = [(1, f'he told us "{far}idiot {far}" and left'), (2, f'"{far}" such an idiot, "{far}'), (3, f"a 5\" pipe {far}. \"idiot\""), (4, f"«{far}idiot{far}»"), (5, f'"{far}\nidiot {far}"')]
    assert {r.doc_id for r in toxicity.toxic_documents(docs(spark, texts)).collect()} == {2, 5}


def test_toxicity_scores_by_brute_force(spark):
    """Each hit by its definition, from whole words and paired marks."""
    rng = random.Random(9)
    forms = ["idiot", "idiiot", "idot", "clown", "clwn", "scum", "scun", "trash", "you", "your", "said", "wrote", '"', "\n", "moon", "river", "x" * 90, "stone", "paper"]
    texts = []
    for i in range(150):
        line = [rng.choice(forms) for _ in range(rng.randrange(4, 40))]
        text, open_ = "", False
        for w in line:
            if w == '"':
                text, open_ = text.rstrip(" ") + (' "' if not open_ else '" '), not open_
            elif w == "\n":
                text, open_ = text + "\n", False
            else:
                text += w + " "
        texts.append((i, text))

    def score(text):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+", text)]
        exact, best = 0.0, {}
        for k, (s, e, w) in enumerate(words):
            term = next((t for t in toxicity.TERMS if t == w or len(t) >= toxicity.FUZZY_CHARS and toxicity.edits_within_one(w, t)), None)
            if term is None:
                continue
            lo = text.rfind("\n", 0, s) + 1
            hi = text.find("\n", e) if "\n" in text[e:] else len(text)
            before, after = words[max(0, k - toxicity.CONTEXT) : k], words[k + 1 : k + 1 + toxicity.CONTEXT]
            pairs = list(zip(*toxicity.enclosed(text[lo:hi])))
            x = 1.0 if w == term else toxicity.FUZZY_SCORE
            if any(a <= s - lo and e - lo <= b for a, b in pairs) or any(v in toxicity.REPORTING and p >= lo for p, _, v in before):
                x *= toxicity.QUOTED
            elif any(v in toxicity.SECOND for *_, v in before + after):
                x *= toxicity.DIRECT
            if w == term:
                exact += x
            else:
                best[w] = max(best.get(w, 0), x)
        return round(exact + sum(best.values()), 6)

    got = {r.doc_id: r.score for r in toxicity.toxic_documents(docs(spark, texts)).collect()}
    want = {i: s for i, t in texts if (s := score(t)) >= toxicity.THRESHOLD}
    assert got == want and 20 < len(want) < 150


def test_toxicity_context_is_whole_words(spark):
    texts = [(1, "bayou " + "x" * 55 + " idiot"), (2, "you " + "x" * 200 + " idiot"), (3, "she said " + "x" * 200 + " idiot")]
    assert {r.doc_id: r.score for r in toxicity.toxic_documents(docs(spark, texts)).collect()} == {1: 1.0, 2: 1.5}


def test_toxicity_messy(spark):
    assert rows(toxicity.toxic_documents(messy(spark), labels(spark))) == [] and rows(toxicity.toxic_documents(docs(spark, []), labels(spark))) == []
    assert toxicity.toxic_documents(docs(spark, [(None, "scum"), (3, "scum"), (3, "scum")])).count() == 3


# ---- 5 token counts
def test_length_report_against_brute_force(spark):
    texts = [prose(i, 5 * (i % 7)) for i in range(40)] + [None, ""]
    report = token_counts.length_report(docs(spark, list(enumerate(texts))))
    n = [len(_tokens.encoder().encode_ordinary(t)) if t else 0 for t in texts]
    got = {r.context_limit: r for r in report.collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert (r.n_docs, r.docs_over, r.tokens_total, r.truncated_total) == (n.count(limit), sum(x > limit for x in n), sum(n), sum(min(x, limit) for x in n))
        assert r.docs_within == len(n) - r.docs_over and r.tokens_lost == sum(n) - r.truncated_total
    for limit in (0, 3, 17, 1000):
        assert tuple(token_counts.at_limit(report, limit).first()) == (sum(x > limit for x in n), sum(min(x, limit) for x in n), sum(n) - sum(min(x, limit) for x in n))


def test_encoding_equals_the_encoder_with_long_gaps():
    enc, r = _tokens.encoder(), random.Random(3)
    for _ in range(60):
        gap = lambda: "".join(r.choice([" ", "\n", "\t", "\u2003"]) * r.randrange(1, 900) for _ in range(r.randrange(1, 6)))
        text = "".join(r.choice([gap(), prose(r.randrange(99), 5), "x", "!?", "7", "\x1c", " "]) for _ in range(8))
        assert _tokens.encode(enc, text) == enc.encode_ordinary(text)
    one = " " * 5000
    for text in (one, one + "x", "x" + one, one + "\n" + "x", one + "\nx" + one):
        assert _tokens.encode(enc, text) == enc.encode_ordinary(text)


def test_quantiles(spark):
    texts = [prose(i, 3 * (i % 9)) for i in range(50)]
    report = token_counts.length_report(docs(spark, list(enumerate(texts))))
    n = sorted(len(_tokens.encoder().encode_ordinary(t)) for t in texts)
    for share in (0, 0.1, 0.5, 0.9, 1):
        assert token_counts.quantile(report, share).first()[0] == n[max(0, math.ceil(share * 50) - 1)]
    assert token_counts.quantile(token_counts.length_report(docs(spark, [])), 0.5).first()[0] is None


def test_token_counts_messy(spark):
    assert sum(r.n_docs for r in token_counts.length_report(messy(spark)).collect()) == 10
    assert token_counts.length_report(docs(spark, [])).count() == 0


# ---- 6 packing
def test_dot_product_is_the_heuristic():
    rng = np.random.default_rng(1)
    limits = np.array([100, 4, 60])
    sizes = np.column_stack([rng.integers(1, 61, 80), np.ones(80, int), rng.integers(0, 30, 80)])
    where, slot = packing.dot_product(sizes, limits)
    mean, left, b = (sizes / limits).mean(axis=0), list(range(80)), 0
    while left:  # the definition, one example at a time
        free, k = limits.copy(), 0
        while fits := [i for i in left if (sizes[i] <= free).all()]:
            best = max(fits, key=lambda i: (round(float((sizes[i] / limits * mean) @ (free / limits)), 12), -i))
            assert (where[best], slot[best]) == (b, k)
            free, k = free - sizes[best], k + 1
            left.remove(best)
        b += 1


def sequences(df):
    """{ex_id: [(piece, tokens, loss)]} as the packed sequences give them back, and the rows."""
    out, got = collections.defaultdict(list), df.collect()
    for r in got:
        ends = [*r.starts[1:], r.n_tokens]
        assert r.n_tokens == len(r.tokens) == len(r.loss) and r.n_loss == sum(r.loss)
        for ex, piece, s, e in zip(r.doc_ids, r.pieces, r.starts, ends):
            out[ex].append((piece, r.tokens[s:e], r.loss[s:e]))
    return {ex: sorted(p) for ex, p in out.items()}, got


def test_packing_round_trip_within_limits(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", prose(c * 7 + t, 30 * (1 + (c + t) % 9))) for c in range(30) for t in range(4)] + [(99, 0, None, None), (None, 1, "assistant", "lamp stone"), (None, 1, "user", "moon")]
    rows = spark.createDataFrame([*turns, turns[0]], "conv_id long, turn long, role string, text string")  # a repeated row
    back, got = sequences(packing.pack(packing.conversation_examples(rows), 256, 3, 200, group=16))
    enc = _tokens.encoder().encode_ordinary
    for c in range(30):
        tokens, loss = [], []
        for _, t, role, text in turns[c * 4 : c * 4 + 4]:
            tokens += enc(text)
            loss += [role == "assistant"] * len(enc(text))
        pieces = back[c]
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert sum((t for _, t, _ in pieces), []) == tokens and sum((m for _, _, m in pieces), []) == loss
        for (_, t, m), (_, t2, m2) in zip(pieces, pieces[1:]):  # cut only where a limit is met
            assert len(t) == 256 or sum(m) == 200 and m2[0]
    assert sorted(t for _, t, _ in back[None]) == sorted([enc("lamp stone"), enc("moon")]) and back[99] == [(0, [], [])]
    packed = [r for r in got if r.bin_id is not None]
    assert all(r.n_tokens <= 256 and len(r.doc_ids) <= 3 and r.n_loss <= 200 for r in packed) and len({r.bin_id for r in packed}) == len(packed)
    assert [r.doc_ids for r in got if r.bin_id is None] == [[99]]
    with pytest.raises(ValueError):
        packing.pack(packing.conversation_examples(rows), 0, 1, 1)


def examples(spark, rows):
    """(ex_id, [(loss, tokens)]) as ``pack`` takes them."""
    out = [(ex, 0, [(i, loss, bytearray(np.array(tokens, packing.id_type(_tokens.VOCABULARY)).tobytes())) for i, (loss, tokens) in enumerate(parts)]) for ex, parts in rows]
    return spark.createDataFrame(out, "ex_id long, first_piece long, parts array<struct<turn: long, loss: boolean, tokens: binary>>")


def test_packing_cuts_only_what_does_not_fit(spark):
    ex = examples(spark, [(1, [(False, [7] * 3000), (True, [7] * 500)]), (2, [(True, [8] * 4000)])])
    back, _ = sequences(packing.pack(ex))
    assert len(back[1]) == 1 and [len(t) for _, t, _ in back[2]] == [3072, 928]
    assert packing.cuts(np.ones(4096, bool), 4096, 4096) == [0, 4096] and packing.cuts(np.zeros(9, bool), 4, 1) == [0, 4, 8, 9]


def test_packing_groups_are_even_whatever_repeats(spark):
    got = packing.pack(examples(spark, [(None, [(True, [1, 2])])] * 4000), group=500).select("bin_id", "doc_ids").collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.bin_id >> 20] += len(r.doc_ids)
    assert len(sizes) == 8 and max(sizes.values()) < 600 and sum(sizes.values()) == 4000


def test_packing_messy(spark):
    assert packing.pack_documents(docs(spark, [])).count() == 0
    back, got = sequences(packing.pack_documents(messy(spark)))
    assert sum(r.bin_id is None for r in got) == 2 and len(back[5]) == 2 and max(r.n_tokens for r in got) == packing.MAX_TOKENS


# ---- 7 sharding
def test_sharding_shares_and_movement(spark):
    d = docs(spark, [(i, "") for i in range(3000)])
    tree = {"a": {"r": {"x": 1.0, "y": 3.0}}, "b": {"s": {"z": 4.0}, "t": {"w": 0.0, "v": 8.0}}}
    old = {r.doc_id: r for r in sharding.place(d, tree).collect()}
    share = collections.Counter(r.shard for r in old.values())
    assert share["w"] == 0 and all(abs(share[s] / 3000 - w / 16) < 0.03 for s, w in dict(x=1, y=3, z=4, v=8).items())
    tree["a"]["r"]["y"] = 5.0
    new = {r.doc_id: r for r in sharding.place(d, tree).collect()}
    moved = [(old[i], new[i]) for i in old if old[i].shard != new[i].shard]
    assert moved and all(n.region == "a" for _, n in moved)  # a subtree that grows only takes
    assert all(n.shard == "y" for o, n in moved if o.region == "a")
    for bad in ({}, {"a": {"r": {"x": -1.0}}}, {"a": {"r": {"x": 0.0}}}):
        with pytest.raises(ValueError):
            sharding.flat(bad)


def test_sharding_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(rows(sharding.query(spark, sf))) == sorted(c.execute(sharding.oracle()).fetchall())
    got = sharding.place(messy(spark))
    assert got.count() == len(rows(messy(spark))) and got.where("shard is null").count() == 0 and sharding.place(docs(spark, [])).count() == 0


# ---- 8 near duplicates
def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = prose(g, 90).split()
        for _ in range(1 + g % 4):
            w = list(base)
            for _ in range(g):
                w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma"])
            texts.append(" ".join(w))
    texts = list(enumerate(texts))
    sets = {}
    for i, t in texts:
        w = re.findall(r"\w+", t.lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= minhash.THRESHOLD:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                pairs.append((a, b))
    got = {r.doc_id: (r.group_id, r.keep) for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert sum(got[a][0] == got[b][0] for a, b in pairs) >= 0.9 * len(pairs) > 10  # the candidate search is approximate
    assert all(find(i) == find(g) and keep == (g == i) for i, (g, keep) in got.items())  # verification is exact
    assert {r.doc_id for r in minhash.one_of_each(docs(spark, texts)).collect()} == {i for i, (_, keep) in got.items() if keep}


def test_near_duplicates_of_one_crowded_bucket(spark):
    """A shared passage puts unlike documents into common buckets, compared in blocks; the groups stay the same."""
    passage = prose(77, 40)
    texts = [(i, passage + " " + " ".join(f"u{i}w{k}" for k in range(30))) for i in range(60)]
    texts += [(100 + i, t + f" z{i}") for i, t in texts[:5]]
    want = {r.doc_id: r.group_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert all(want[100 + i] == want[i] for i in range(5))
    roots = {r.id: r.root for r in minhash.groups(docs(spark, texts), bands=minhash.BANDS, block=8).collect()}
    assert {i: roots.get(i, i) for i, _ in texts} == want


def test_signatures_estimate_jaccard():
    x = np.arange(3000, dtype=np.uint32) * np.uint32(2654435761)
    s = minhash.signatures(np.concatenate([x[:2000], x[1000:3000]]), np.array([0, 2000]))
    assert abs((s[:, 0] == s[:, 1]).mean() - 1 / 3) < 0.13
    assert len(set(minhash.sigma(np.arange(100_000, dtype=np.uint32)).tolist())) == 100_000


def test_near_duplicates_messy(spark):
    got = sorted(rows(minhash.near_duplicates(messy(spark))), key=str)
    assert len(got) == 10 and (None, None, 1, True) in got and got.count((5, 5, 2, True)) == 2 and (6, 5, 2, False) in got and (2, 2, 1, True) in got
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    chain = [(i, i + 1) for i in range(40)]
    assert {r.root for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


# ---- 9 quality classifier
def test_classifier_accuracy(spark):
    texts = [(i, prose(i) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i).split())) for i in range(240)]
    l = labels(spark, [(i, int(i % 3 > 0), 0) for i in range(120)])
    got = {r.doc_id: r for r in quality_classifier.classify(docs(spark, texts), l).collect()}
    held_out = [got[i].keep == (i % 3 > 0) for i in range(120, 240)]
    assert sum(held_out) / len(held_out) >= 0.95


def test_posteriors_by_brute_force(spark):
    """Sparse and large sites, a null one, and documents without evidence; each document's own evidence left out."""
    rng = random.Random(6)
    sites = [("big", "a", 50, 0.9), ("big", "b", 30, 0.2), ("mid", "a", 8, 0.6), ("lone", "c", 1, 0.1), (None, "a", 3, 0.5), ("big", None, 2, 0.4)]
    ev = [(h, p, None if rng.random() < 0.1 else min(0.999, max(0.001, rng.gauss(m, 0.1)))) for h, p, n, m in sites for _ in range(n)]
    ev = [(i, *e) for i, e in enumerate(ev)]
    got = {r.doc_id: r for r in quality_classifier.combined(spark.createDataFrame(ev, "doc_id long, host string, path string, p_doc double")).collect()}
    use = [e for e in ev if e[3] is not None]
    mean = sum(e[3] for e in use) / len(use)

    def strength(groups):
        groups = [(n, s, m) for n, s, m in groups if n]
        spread = sum((s / n - m) ** 2 - m * (1 - m) / n for n, s, m in groups) / len(groups)
        k = sum(m * (1 - m) for *_, m in groups) / len(groups) / max(spread, 1e-9) - 1
        return min(quality_classifier.STRENGTH[1], max(quality_classifier.STRENGTH[0], k))

    of = lambda **by: [e[3] for e in use if all(e[{"host": 1, "path": 2}[k]] == v for k, v in by.items())]
    hosts, paths = {e[1] for e in ev}, {e[1:3] for e in ev}
    kh = strength([(len(of(host=h)), sum(of(host=h)), mean) for h in hosts])
    kp = strength([(len(of(host=h, path=p)), sum(of(host=h, path=p)), (kh * mean + sum(of(host=h))) / (kh + len(of(host=h)))) for h, p in paths])
    logit = lambda p: math.log(p / (1 - p))
    for i, h, p, own in ev:
        rest = [e for e in use if e[0] != i]
        everyone = sum(e[3] for e in rest) / len(rest)
        at = [e[3] for e in rest if e[1] == h]
        ph = (kh * everyone + sum(at)) / (kh + len(at))
        at = [e[3] for e in rest if e[1:3] == (h, p)]
        pp = (kp * ph + sum(at)) / (kp + len(at))
        z = logit(pp) + (0 if own is None else logit(own) - logit(everyone))
        assert abs(got[i].p_host - ph) < 1e-6 and abs(got[i].p_path - pp) < 1e-6 and abs(got[i].p_quality - 1 / (1 + math.exp(-z))) < 1e-6


def test_classifier_on_sites_of_addresses(spark):
    urls = [(1, "https://User@Blog.Example.com:80/fr/8?x=/y"), (2, "http://blog.example.com/#top"), (3, "no address"), (4, None), (5, "https://a.org")]
    got = {r.i: (r.host, r.path) for r in quality_classifier.with_site(spark.createDataFrame(urls, "i int, url string")).collect()}
    assert got == {1: ("blog.example.com", "fr"), 2: ("blog.example.com", ""), 3: (None, None), 4: (None, None), 5: ("a.org", "")}
    pages = quality_classifier.with_site(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id as doc_id", "url", "html as text"))
    out = quality_classifier.classify(pages, labels(spark, [(i, i % 2, 0) for i in range(20)]), host="host", path="path")
    assert out.count() == pages.count() and out.where("p_quality is null").count() == 0


def test_classifier_messy(spark):
    for l in (labels(spark), labels(spark, [(5, 1, 0), (7, 0, 0)])):
        got = rows(quality_classifier.classify(messy(spark), l))
        assert len(got) == 10 and all(0 < r[4] < 1 for r in got)
    assert quality_classifier.classify(docs(spark, []), labels(spark)).count() == 0


# ---- 10 decontamination
def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(200 + i, 25)) for i in range(6)]
    texts = []
    for i, (_, t) in enumerate(items):
        for edits in (0, 3, 6, 9, 14):
            w = list(t)
            for _ in range(edits):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
            texts.append(prose(i) + " " + "".join(w).upper() + "\n" + prose(50 + i))
    texts = list(enumerate(texts))
    index = decontam.Index(items)

    def fewest(p, t):
        d = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            prev, d[0] = d[0], i
            for j, e in enumerate(t, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (c != e))
        return min(d)

    want = {(d, index.item[w]) for d, t in texts for w in range(len(index.texts)) if fewest(index.texts[w], decontam.plain(t)) <= index.k[w]}
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminations(docs(spark, texts), bench).collect()}
    assert got == want and len(want) >= 12
    assert {(r.doc_id, r.item_id) for r in decontam.contaminations(docs(spark, texts), bench, slice_bytes=400).collect()} == want
    kept = decontam.without_benchmark(docs(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in want} and kept.columns == docs(spark, []).columns


def test_decontamination_messy(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, prose(1)), (4, prose(5, 60))], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminations(messy(spark), bench).collect()), key=str)
    assert got == sorted([(None, None), (5, 4), (5, 4), (6, 4)], key=str)
    assert decontam.without_benchmark(messy(spark), bench.limit(0)).count() == 10 and decontam.contaminations(docs(spark, []), bench).count() == 0


# ---- very long texts without a break
HUGE = {"spaces": " " * 1_000_000 + "x", "newlines": "\n" * 1_000_000, "letters": "qzjx" * 250_000, "mixed": "aB3" * 333_333}


@pytest.fixture(scope="module")
def huge(spark, tmp_path_factory):
    where = f"{tmp_path_factory.mktemp('huge')}/d"
    docs(spark, [(1, prose(1, 40)), *((10 + i, v) for i, v in enumerate(HUGE.values()))]).write.parquet(where)
    return spark.read.parquet(where)


OPERATORS = {
    "secrets": lambda d, l, b: secrets.secret_scan(d),
    "lines": lambda d, l, b: lines.line_dedup(d),
    "quality_rules": lambda d, l, b: quality_rules.quality_rules(d, l),
    "toxicity": lambda d, l, b: toxicity.toxic_documents(d, l),
    "token_counts": lambda d, l, b: token_counts.length_report(d),
    "packing": lambda d, l, b: packing.pack_documents(d),
    "sharding": lambda d, l, b: sharding.place(d),
    "minhash": lambda d, l, b: minhash.near_duplicates(d),
    "quality_classifier": lambda d, l, b: quality_classifier.classify(d, l),
    "decontam": lambda d, l, b: decontam.contaminations(d, b),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_texts_of_a_million_characters(spark, huge, name):
    bench = spark.createDataFrame([(1, prose(1, 40)), (2, "x" * 120)], "item_id long, text string")
    got = OPERATORS[name](huge, labels(spark, [(1, 1, 0), (12, 0, 1)]), bench).collect()
    if name == "token_counts":
        enc = _tokens.encoder()
        assert sorted(r.context_limit for r in got) == sorted({len(_tokens.encode(enc, t)) for t in [prose(1, 40), *HUGE.values()]})
    elif name == "packing":
        enc = _tokens.encoder()
        assert sum(r.n_tokens for r in got) == sum(len(_tokens.encode(enc, t)) for t in [prose(1, 40), *HUGE.values()])
    elif name in ("lines", "quality_rules", "sharding", "minhash", "quality_classifier"):
        assert len(got) == 5
    elif name == "decontam":
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 1)}
