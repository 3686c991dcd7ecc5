"""The corpus operators against brute force on small data."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from voxtable.llm import backoff_automaton, bin_slack, cap_filters, disclosure, language, licences, minhash_forest, spaced_seeds, warc
from voxtable.llm.common import components
from voxtable.llm.tag_ratio import main_text
from voxtable.llm.tokens import words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def groups(ids, links):
    """Least id reachable from each id."""
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed=3, n=60):
    """Texts with copies, near copies and a shared passage."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéä") for _ in range(r.randint(1, 6))) for _ in range(300)]
    shared = [r.choice(vocab) for _ in range(30)]
    texts = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 40, 90, 200]))]
        if i % 7 == 0:
            w += shared
        if i % 3 and texts:
            w = list(r.choice(texts))
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(w)
    return [(i, r.choice(["  ", " ", "\n"]).join(w).capitalize()) for i, w in enumerate(texts)]


def test_words_of_a_column():
    texts = ["", None, "A  b\tÇa", "\n", "x" * 50, "a b", "c"]
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] for w in words(pa.array(texts), size=8)]
    assert sum(got, []) == [x for t in texts for x in WORD.findall(t or "")]
    one, two = (next(words(pa.array([t]))).hash for t in ("ABC def", "abc DEF"))
    assert (one == two).all()


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)]
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = groups({i for p in links for i in p}, links)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}


def test_near_duplicates(spark):
    docs = corpus() + [(100 + k, None) for k in range(2)] + [(200 + k, "x y") for k in range(3)]
    got = {x.doc_id: x for x in minhash_forest.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    assert len(set(want.values())) < len(want) - 10
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


@pytest.mark.parametrize("dim", [16, 64])
def test_vector_links(spark, dim):
    r = np.random.RandomState(dim)
    base = r.randn(150, dim)
    v = np.concatenate([base, base[:40] + 0.2 * r.randn(40, dim), base[:1] + 0.12 * r.randn(450, dim), base[5:8], base[9:10] * 3]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, [0.0] * dim), (9003, [float("nan")] * dim), (9004, [None] * dim), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]
    got = {x.vec_id: x for x in cap_filters.vector_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = groups(range(len(v)), zip(*np.nonzero(near)))
    n = near.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(v))])
    assert n.sum() > 1000 and (found <= n).all() and found.sum() >= 0.9999 * n.sum()
    assert all(got[i].component_id == want[i] for i in range(len(v)))
    assert [got[k].n_links for k in range(9001, 9008)] == [0, 0, 0, 0, 0, 1, 1] and got[9007].component_id == 9006


def test_packing_plan_is_full_and_exact():
    r = random.Random(4)
    counts = collections.Counter(min(1024, 1 + int(r.expovariate(1 / 200))) for _ in range(4000))
    steps = bin_slack.plan(dict(counts))
    bins = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for length, a, b, first, k, offset in steps:
        for rank in range(a, b):
            ranks[length].append(rank)
            bins[first + (rank - a) // k].append((offset + (rank - a) % k * length, length))
    assert all(sorted(ranks[x]) == list(range(n)) for x, n in counts.items())
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(x * n for x, n in counts.items()) // 1024) + 3
    assert bin_slack.fullest({5: 3, 4: 1, 3: 2}, 13) == {5: 2, 3: 1}


def test_pieces_have_the_tokenizers_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(8)
    marks = ["a", "B ", " ", "  ", "\n", "\n\n", "\t", "é", "ñ", "日本", " ", " ", "　", "\x1c", "\x85", "'s", "12", "<|endoftext|>", "😀", ".", "!?", "the "]
    docs = [(i, "".join(r.choice(marks) for _ in range(r.randint(0, 60)))) for i in range(400)] + [(1000, "the end of it " * 900), (1001, None)]
    rows = bin_slack.pack(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), path).collect()
    tk = Tokenizer.from_file(path)
    want = {}
    for i, t in docs:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)]
        want |= {(i, k): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in rows} == want
    bins = collections.defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append((x.offset, x.length))
    for v in bins.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() and sum(n for _, n in v) <= 1024


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_follow_the_smoothed_model(spark, order):
    docs = corpus(9, 80) + [(300, None), (301, " ")]
    k = 30.0
    got = {x.doc_id: x for x in backoff_automaton.score_texts(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), order, k).collect()}
    texts = {i: [*WORD.findall(lower(t)), None] for i, t in docs}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    c = [collections.Counter() for _ in range(order + 1)]
    for i in texts.keys() - held:
        x = [None, *texts[i]]
        for n in range(1, order + 1):
            c[n].update(tuple(x[j - n + 1:j + 1]) for j in range(1, len(x)) if j - n + 1 >= 0)
    tokens, known = sum(c[1].values()), len(c[1])
    for i, t in texts.items():
        x, score, base = [None, *t], 0.0, 0.0
        for j in range(1, len(x)):
            p = (c[1][x[j],] + 1) / (tokens + known + 1)
            base += math.log10(p)
            for n in range(2, min(order, j + 1) + 1):
                h = c[n - 1][tuple(x[j - n + 1:j])]
                if h:
                    p = (c[n][tuple(x[j - n + 1:j + 1])] + k * p) / (h + k)
            score += math.log10(p)
        g = got[i]
        assert (g.n_tokens, g.train_tokens, g.held_out, g.n_known) == (len(t), tokens, i in held, sum(c[1][w,] > 0 for w in t))
        assert g.base_score == pytest.approx(base) and g.score == pytest.approx(score)


def test_model_is_a_distribution():
    """Over all known words and one unknown, probabilities behind a seen word add up to one."""
    train = next(words(pa.array(["a b a c", "b a", "c c a b"])))
    tokens, first = backoff_automaton.token_stream(train)
    grams = backoff_automaton.grams_of(tokens, first, 2)
    counts = [np.unique(g, return_counts=True) for g in grams]
    known = len(counts[0][0])
    model = backoff_automaton.BackoffAutomaton(counts, len(tokens), known, 8.0)
    total = 0.0
    for nxt in ("a", "b", "c", "zzz", ""):
        w = next(words(pa.array([f"a {nxt}"])))
        s, f = backoff_automaton.token_stream(w)
        total += 10 ** model.traverse(s, f, 2)[0][1]
    assert total == pytest.approx(1.0)


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for o, (k, p) in enumerate(KINDS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x - 9 * (x > 9) for x in (int(c) * (1 + j % 2) for j, c in enumerate(reversed(d)))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else True, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), o, m.end()))
    return sorted(out)


def test_base_spans_of_odd_texts(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 80))) for chars in ("ab1@.+- ()94é😀\n%_x0:", "0123456789 -", "0123456789.", "ab@.@_") for _ in range(300)]
    texts += [None, "", "a" * 20000, "1" * 20000, "1.2.3.4 " * 700, "a." * 500 + "@b" + ".c" * 5000, "+1" + "." * 3000, "é4111 1111 1111 1111x +1 (555) 123-4567 000.1.2.255 x@y.z@q.r"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4).select("i", disclosure.base_spans("text").alias("s")).collect()
    for x in rows:
        assert [(s.start, s.kind, s.end) for s in x.s] == base_spans(texts[x.i]), texts[x.i]


def test_disclosing_terms_and_sanitising(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["apple", "river", "stone", "cloud"]) for _ in range(20))) for i in range(1000, 1900)]
    docs += [(400 + i, f"note {i} by Quizzlewick of river town: q@w.org and stone {i}") for i in range(5)]
    docs += [(500, "+1 (132) 555-1352 4111111111111111 done"), (501, None), (502, "plain river")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("terms", disclosure.F.lit(1))
    found = {x.doc_id: x for x in disclosure.report(disclosure.find_spans(df)).collect()}
    at = docs[900][1].index("Quizzlewick")
    assert f"term:{at}:{at + 11}" in found[400].spans and found[502].spans == "" and found[400].n_email == 1
    assert "river" not in {docs[900][1][int(a):int(b)] for k, a, b in (s.split(":") for s in found[400].spans.split(",")) if k == "term"}
    assert all(x.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in base_spans(dict(docs)[i])).encode()).hexdigest() for i, x in found.items())
    clean = {x.doc_id: x for x in disclosure.sanitise(df).collect()}
    assert clean[400].terms == 1 and "Quizzlewick" not in clean[400].text and "[EMAIL]" in clean[400].text
    assert clean[500].text == "[PHONE] [CARD] done" and clean[501].text is None and clean[502].text == "plain river" and len(clean) == len(docs)


def test_terms_are_found_in_whole_texts(spark):
    """The name at the head and the address at the foot count together, and the name goes wherever it stands."""
    r = random.Random(6)
    fill = lambda n=20: " ".join(r.choice(["apple", "river", "stone", "cloud"]) for _ in range(n))
    docs = [(i, fill()) for i in range(1000, 1900)]
    docs += [(i, f"by Quizzlewick {fill(60)} mail q@w.org {i} {fill(60)} QUIZZLEWICK") for i in range(5)]
    docs += [(10 + i, f"{fill(9)} quizzlewick, alone {i}") for i in range(4)]
    docs += [(20 + i, f"{fill(9)} Brompton {fill(60)} {i} b@w.net") for i in range(3)] + [(30, "a Brompton é😀 brompton")]
    docs += [(40 + i, "Copied words c@w.com") for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = {x.doc_id: x.spans.split(",") for x in disclosure.report(disclosure.find_spans(df)).collect()}
    clean = {x.doc_id: x.text for x in disclosure.sanitise(df).collect()}
    for i, t in docs:
        at = [m.span() for m in re.finditer("quizzlewick|brompton", t, re.I)]
        assert all(f"term:{a}:{b}" in found[i] for a, b in at), t
        assert not re.search("quizzlewick|brompton|@", clean[i], re.I)
    assert clean[10].endswith("[TERM], alone 0") and clean[40].startswith("Copied words") and clean[1000] == docs[0][1] and len(clean) == len(docs)


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(6)
    pages = [(i, f"http://h/{i}\r\nX: y", r.choice(["", "<p>ä</p>", "x" * 150, "y" * 100, "z" * 99, None, "".join(r.choice("ab<>\r\n") for _ in range(r.randint(0, 9000)))])) for i in range(60)]
    archives = warc.write_archives(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3))
    raw = {i: (h or "").encode() for i, _, h in pages}
    first = {}
    for i in sorted(raw):
        first.setdefault(raw[i], i)
    want = {i: (len(b), hashlib.sha256(b).hexdigest(), *(("revisit", first[b]) if len(b) >= 100 and first[b] != i else ("response", None))) for i, b in raw.items()}
    for size in (1 << 20, 1500):
        rows = warc.read_archives(archives, size, payloads=True).collect()
        assert len(rows) == len(raw) and {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in rows} == want
        assert all(bytes(x.payload) == raw[x.page_id] for x in rows if x.record_type == "response")


def test_ranges_survive_false_magic(tmp_path):
    """Every cut gives each record once, also where payloads hold gzip members themselves."""
    inner = zlib.compressobj(9, zlib.DEFLATED, 31)
    trap = inner.compress(b"not a record") + inner.flush()
    blob = b""
    for i in range(6):
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        blob += z.compress(warc.record_bytes(i, "u", trap * 3, hashlib.sha256(trap * 3).hexdigest(), None)) + z.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(blob)
    for size in (1, 7, 100, 333, len(blob)):
        got = [warc.parse_record(x)["page_id"] for s in range(0, len(blob), size) for x in warc.records_of(str(path), len(blob), s, min(s + size, len(blob)))]
        assert got == list(range(6))


PAGE = """<html><head><title>t</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu one</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this long long notice text.</p></div><div class="ad">Buy this now.</div>{article}
<aside class="sidebar"><p>Other things.</p></aside><section id="comments"><article class="comment"><p>First reader comment that is quite long, really.</p></article></section>
<form><label>Mail</label></form><footer>&copy; 2020 Site</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>Some <b>long\n  text</b> with <a href=y>a link</a> in it &mdash; yes.</p><p>Short.</p><ul><li>One item</li><li>Two</li></ul><blockquote>Quoted words that go on for a while.</blockquote>"
TEXT = "Head & line\nSome long text with a link in it — yes.\nShort.\nOne item\nTwo\nQuoted words that go on for a while."


@pytest.mark.parametrize("article", [f"<article>{BODY}</article>", f"<main><div>{BODY}</div></main>", f"<div class=content>{BODY}</div>", f"<div><article>{BODY}<footer>By me</footer></article></div>"])
def test_main_text(article):
    assert main_text(PAGE.format(article=article)) == TEXT


def test_main_text_of_odd_pages():
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("just text &lt;") == "just text <"
    assert main_text("<nav><a>m</a><article><p>Body of it</p></article>") == "Body of it"
    assert main_text("<article><p>open <b>bold<p>next") == "open bold\nnext"


def test_language_fusion(spark):
    r = random.Random(7)
    kinds = {"en": ["the", "and", "thing", "with", "shall"], "de": ["der", "und", "schön", "nicht", "über"], "fr": ["le", "être", "où", "quel", "ça"]}
    known = [(k, " ".join(r.choice(w) for _ in range(15))) for k, w in kinds.items() for _ in range(30)]
    docs = [(i, k, f"http://www.{k}.example.com/{k}/{i}", t) for i, (k, t) in enumerate(known)]
    docs += [(900, "fr", "http://www.fr.example.com/fr/1", "x"), (901, None, None, "数据 数据 数据 数据 数据 数据"), (902, "en", None, "123 !!"), (903, None, None, None), (904, "zz9", "u", "der und nicht")]
    rows = {x.doc_id: x for x in language.identify(spark.createDataFrame(docs, "doc_id bigint, lang string, url string, text string"), spark.createDataFrame(known, "language string, text string"), declared="lang", address="url").collect()}
    assert len(rows) == len(docs) and all(rows[i].language == k and rows[i].accepted for i, (k, _) in enumerate(known))
    assert rows[900].language == "fr" and rows[904].language == "de"
    assert not rows[901].accepted and not rows[902].accepted and not rows[903].accepted and rows[903].language == "und"
    assert all(0 < x.probability <= 1 for x in rows.values())


def test_a_rare_language_of_a_large_table_is_known(spark):
    r = random.Random(12)
    say = lambda w, n=12: " ".join(r.choice(w) for _ in range(n))
    kinds = {"en": ["the", "and", "thing", "with", "shall"], "cy": ["mae", "yng", "nghymru", "llawer", "hwyl"]}
    copy = say(kinds["en"])
    docs = [(i, "en", copy if i % 3 == 0 else say(kinds["en"])) for i in range(12000)] + [(20000 + i, "cy", say(kinds["cy"])) for i in range(3)]
    docs += [(30000, None, say(kinds["cy"]))] + [(40000 + i, f"x{i // 2:02d}"[:3], say([f"{chr(97 + i // 2 % 26)}q{chr(97 + i // 52)}w"])) for i in range(140)]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string").repartition(4)
    langs, weights = language.fit(df.selectExpr("lang language", "text"))
    assert len(langs) == 73 and langs[:2] == ["en", "cy"] and langs[-1] == "und" and weights.shape[0] == 73
    one, two = (language.fit(df.where("lang = 'en'").selectExpr("lang language", "text").unionAll(x))[1] for x in (df.where("lang = 'en'").limit(0).selectExpr("lang", "text"), df.where("doc_id = 3").selectExpr("lang", "text")))
    assert np.allclose(one, two, atol=1e-4)
    rows = {x.doc_id: x for x in language.identify(df.where("doc_id < 40000"), df.where("doc_id < 40000").selectExpr("lang language", "text"), declared="lang").collect()}
    assert all(rows[i].language == "cy" and rows[i].accepted for i in (20000, 20001, 20002, 30000)) and rows[5].language == "en"


def test_spaced_seeds(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    item = [[r.choice(vocab) for _ in range(n)] for n in (30, 14, 6, 4, 2)]
    pad = lambda n: [r.choice(vocab) for _ in range(n)]
    changed = list(item[0])
    for k in (4, 11, 19, 26):
        changed[k] = "zzz"
    docs = [(0, pad(50) + item[0] + pad(50)), (1, pad(20) + changed), (2, pad(300)), (3, item[1]), (4, pad(3) + item[2] + pad(3)), (5, pad(5) + item[3]), (6, item[4]), (7, pad(9) + item[0][:16] + pad(9)), (8, item[0][:6] + pad(60)), (9, [])]
    rows = spaced_seeds.contamination(spark.createDataFrame([(i, " ".join(w).upper()) for i, w in docs] + [(10, None)], "doc_id bigint, text string"),
                                      spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(item)] + [(9, None)], "item_id bigint, text string")).collect()
    got = {(x.doc_id, x.item_id): (x.first_word, x.end_word, x.matches) for x in rows}
    assert got == {(0, 0): (50, 80, 30), (1, 0): (20, 50, 26), (3, 1): (0, 14, 14), (4, 2): (3, 9, 6), (5, 3): (5, 9, 4), (7, 0): (9, 25, 16)}


def test_overlap_on_each_side_of_a_replaced_middle():
    item = np.arange(42, dtype=np.uint64)
    doc = np.concatenate([np.full(5, 99, np.uint64), item, np.full(5, 99, np.uint64)])
    doc[5 + 15:5 + 27] = 77
    assert spaced_seeds.overlap(doc, item, 5) == (5, 20, 15)
    r = np.random.RandomState(1)
    for _ in range(300):
        n = r.randint(1, 40)
        item = np.arange(n, dtype=np.uint64)
        doc = np.where(r.rand(n) < r.choice([0.5, 0.7, 0.9]), item, np.uint64(99))
        same = doc == item
        least = max(3, min(spaced_seeds.WORDS, int(np.ceil(spaced_seeds.SHARE * n))))
        good = [(int(same[a:b].sum()), a - b, -a) for a in range(n) for b in range(a + 1, n + 1) if 4 * same[a:b].sum() >= 3 * (b - a) and same[a:b].sum() >= least]
        m, length, a = max(good, default=(0, 0, 0))
        assert spaced_seeds.overlap(doc, item, 0) == ((-a, -a - length, m) if good else None)


def test_licences(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(3, 90)))
    notes = {k: t for k, ts in licences.TEMPLATES.items() for t in ts[:1]}
    docs = [(i, f"{line()}\n{t}\n{line()}", k) for i, (k, t) in enumerate(notes.items())]
    docs += [(50 + i, f"{line()}\n{line()}", "none") for i in range(60)] + [(200, None, "none"), (201, "", "none"), (202, "Licensed under the Fancy License, Version 9.1.", "unknown"), (203, line() + " Released under the MIT License. " + line(), "mit")]
    rows = {x.doc_id: x for x in licences.scan(spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string")).collect()}
    assert {i: rows[i].licence for i, *_ in docs} == {i: k for i, _, k in docs}


def test_wrapped_licences(spark):
    r = random.Random(10)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(3, 14)))
    gpl = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")
    bsd = "Redistribution and use in source\nand binary forms, with or\nwithout modification,\nare permitted"
    lines = lambda t, mark: "\n".join(mark + x for x in t.split("\n"))
    docs = [(k, f"{line()}\n{line()}\n{gap}{lines(t, mark)}\n{gap}{line()}\n{line()}", name)
            for k, (name, t, mark, gap) in enumerate((n, t, m, g) for n, t in (("gpl", gpl), ("bsd", bsd)) for m in ("", " * ", "# ") for g in ("", " \r\n"))]
    docs += [(50 + i, "\n".join(line() for _ in range(9)), "none") for i in range(60)]
    rows = {x.doc_id: x for x in licences.scan(spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string").repartition(3)).collect()}
    assert {i: rows[i].licence for i, *_ in docs} == {i: k for i, _, k in docs}
    assert all(rows[i].families in (k, "") for i, _, k in docs)
