"""Collocations, spelling variants and URL filters against brute force on small tables."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortry.llm import collocations, spelling, url_filter
from cohortry.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.test_operators import ODD, table


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_collocations(rows, least, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            total[lang] += len(w)
            for m in (1, 2, 3):
                count[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in count.items():
        cands = [p for p, a in f.items() if len(p) > 1 and a >= least]
        covered = defaultdict(int)
        for p in cands:
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    covered[q] = max(covered[q], f[p])
        ranked = []
        for p in cands:
            a = f[p]
            if len(p) == 2 and 100 * covered[p] >= 50 * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        ranked.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(ranked[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top,shard,part", [(10, 2000, 1 << 20, 1 << 21), (2, 40, 60, 50)])
def test_collocations(spark, least, top, shard, part):
    rng = random.Random(3)
    pool = [*"a b c d e É the THE x-y ß 漢".split(), "", "\t"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(pool) + rng.choice([" ", " ", " ", ". ", "\n", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [("en", t) for _, t in ODD if len(t or "") < 1000] + [("fr", "one two three " * 400), ("fr", "lone wolf,pack of wolves;" * 30)]
    docs = spark.createDataFrame([(lang, t, "x", 1, "y") for lang, t in rows], "lang string, text string, shard string, size int, w1 string")
    got = [tuple(r) for r in collocations.collocations(docs, least=least, top=top, shard=shard, part=part).collect()]
    assert sorted(got) == brute_collocations(rows, least, top)


def test_packed_phrases_come_back():
    rng = np.random.default_rng(5)
    for m, bits in itertools.product((2, 3), (1, 5, 18, 21, 22, 32, 42)):
        perm = collocations.Permutation(m, bits)
        ids = [rng.integers(0, 1 << bits, 500) for _ in range(m)]
        hi, lo, n = collocations._summed(*perm.pack(ids), None, perm.width)
        want = Counter(zip(*(x.tolist() for x in ids)))
        for p in {0, min(3, perm.width)}:
            part, got = (hi >> np.uint64(perm.width - p)).astype(int), Counter()
            for k in np.unique(part):
                at = part == k
                back = collocations.decode_filter(collocations.encode_filter(hi[at], lo[at], n[at], perm.width, p), int(k), perm.width, p)
                both = collocations.merge_filters([back, back], perm.width)
                assert all((x == y).all() for x, y in zip(back[:2], both[:2])) and (both[2] == 2 * n[at]).all()
                got.update({tuple(map(int, x)): int(c) for *x, c in zip(*perm.unpack(*back[:2]), back[2])})
            assert got == want


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    close, whole, gone = defaultdict(set), defaultdict(set), defaultdict(set)
    for w in words:  # same word after one deletion, or one word is the other's deletion
        for i in range(len(w)):
            whole[i, w[:i], w[i + 1 :]].add(w)
            gone[w[:i] + w[i + 1 :]].add(w)
    for group in whole.values():
        for a, b in itertools.permutations(group, 2):
            close[a].add(b)
    for w in words:
        for x in gone.get(w, ()):
            close[w].add(x)
            close[x].add(w)
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words.get(form[w])))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("tile", [spelling.TILE, 12])
def test_spelling_variants(spark, tile):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "Wörter WÖRTER×÷ " * 300), (5, None), (6, ""), (7, "y" * 150_000 + " "), *[(8, "z" * 9_000 + " ")] * 6, *[(9, "z" * 8_999 + " ")] * 40]
    df = spark.createDataFrame([(i, t, "w", 3, 9) for i, t in rows], "doc_id long, text string, word string, n long, key long")
    got = sorted((tuple(r) for r in spelling.variants(df, tile=tile).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])
    want = brute_variants(rows)
    assert got == want and sum(r[1] is not None for r in want) > 10
    assert spelling.variants(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("tile", [1 << 20, 6])
def test_every_kind_of_edit_is_met_once(spark, tile):
    rng = random.Random(4)
    words = {"".join(rng.choice("abÿ漢") for _ in range(rng.randrange(1, 9))) for _ in range(700)}
    counts = {w: rng.randrange(1, 40) for w in words}
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), tile).collect()}
    for w in words:
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        assert got.get(w) == ((len(close), counts[best], best) if close else None)


def test_long_chain_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w7")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w40" for i in range(40)}, "x": "w40"}


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en", "http://example.com/en/", "https://xexample.com/en/1", "a://b.net/es/://c", "http://net/fr/", "http://a.net?/fr/", "http://a.net#/fr/", "http://u@b.ÄB.COM/ÄB", "http://.com/", "http://a.org/b.com/", "http://www.cheap-pills.org/x", "http://x.ads-track.org/", "http://ads.b.org/\n", "http://a.org/tag/x", "http://a.org/x/tag/y", "http://a.org/p.jpeg", "http://a.org/p.jpg?x", "http://b.org/" + "y" * 50_000 + ".zip", "ftp://x.net/es/\n?", "http://b.org/🎉.zip"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    rules = [r for r in url_filter.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if rules:
        best = max(rules, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict, None
    for g in url_filter.GLOBS:
        literals, loops = url_filter.tokens(g.pattern)
        runs = ["", "[^/]*", ".*"]
        pattern = runs[loops[0]] + "".join(("." if c is None else re.escape(c)) + runs[k] for c, k in zip(literals, loops[1:]))
        if re.fullmatch(pattern, f".{host}{path}", re.S):
            return host, path, None, g.verdict, g.pattern
    return host, path, None, "allow", None


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, URLS[5]])] + [(None, URLS[5], "x", "y")], "page_id long, url string, host string, match string")
    got = [tuple(r) for r in url_filter.judge(pages).collect()]
    want = [(i, *brute_url(u)) for i, u in enumerate([*URLS, URLS[5]])] + [(None, *brute_url(URLS[5]))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert url_filter.judge(pages.where("page_id < 0")).count() == 0
    assert {(r.rule, r.verdict) for r in url_filter.judge(pages, rules=[], globs=[]).collect()} == {(None, "allow")}


def test_automaton_of_many_words():
    rng = random.Random(7)
    globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**", "\\*", "é"]) for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    texts = ["".join(rng.choice("ab/*é") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + [""]
    machine = url_filter.Automaton(globs)
    assert machine.words > 20
    runs, patterns = ["", "[^/]*", ".*"], []
    for g in globs:
        literals, loops = url_filter.tokens(g)
        patterns.append(re.compile(runs[loops[0]] + "".join(("." if c is None else re.escape(c)) + runs[k] for c, k in zip(literals, loops[1:])), re.S))
    want = [next((k for k, p in enumerate(patterns) if p.fullmatch(t)), -1) for t in texts]
    assert machine.first(texts).tolist() == want


def test_spelling_query_on_given_table(spark):
    got = sorted((tuple(r) for r in QUERIES["op12_spelling_variants"](spark, SF).collect()), key=lambda r: r[0])
    assert got == brute_variants([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
