import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import pyarrow as pa
from panelcast.session import cut_lineage
from panelcast.llm import html_text, pii, repeats, token_orc, toxicity
from tests.llm.helpers import AWKWARD, docs, sentence, words


# ---- repeated passages ------------------------------------------------------------------

def brute_repeats(rows, least):
    owners, starts = {}, {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - least + 1):
            owners.setdefault(tuple(w[s:s + least]), set()).add(i)
            starts.setdefault(i, {}).setdefault(s, tuple(w[s:s + least]))
    out = {}
    for i, at in starts.items():
        hit = sorted({p for s, g in at.items() if len(owners[g]) > 1 for p in range(s, s + least)})
        if hit:
            out[i] = hit
    return out


def test_repeats_against_brute_force(spark):
    rnd = random.Random(7)
    passages = [sentence(rnd, n) for n in (50, 51, 60, 49, 48, 120)]
    rows = [(i, sentence(rnd, rnd.randint(0, 90)) + " " + " ".join(rnd.sample(passages, rnd.randint(0, 2))) + " " + sentence(rnd, rnd.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, "ha " * (40 + 5 * i)) for i in range(5)] + [(200 + i, rows[i][1]) for i in range(5)]
    got = repeats.repeated_passages(docs(spark, rows)).collect()
    spans = {r.doc_id: [p for s in r.spans for p in range(s.start, s.end)] for r in got}
    assert spans == brute_repeats(rows, 50)
    assert all(r.n_repeated_words == len(spans[r.doc_id]) and r.n_spans == len(r.spans) for r in got)


def test_cutting_repeats_keeps_one_owner(spark):
    rnd = random.Random(8)
    shared = sentence(rnd, 70)
    rows = [(3, "head of three " + shared + " tail"), (1, shared), (2, "other\n" + shared), (4, None), (5, sentence(rnd, 60))]
    table = docs(spark, rows)
    got = repeats.without_repeats(table)
    assert got.columns == table.columns
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[1] == shared and text[3] == "head of three tail" and text[2] == "other\n" and text[4] is None and text[5] == rows[4][1]


def test_repeats_of_awkward_rows(spark):
    assert repeats.repeated_passages(docs(spark, AWKWARD)).count() == 0
    assert repeats.repeated_passages(docs(spark, [])).count() == 0
    long = "long " * 30_000
    got = {r.doc_id: r.n_repeated_words for r in repeats.repeated_passages(docs(spark, [(1, long), (2, long[:5000]), (3, long)])).collect()}
    assert got == {1: 30_000, 2: 1000, 3: 30_000}


# ---- main text --------------------------------------------------------------------------

def page(main, before="", after=""):
    return f"<html><head><title>T</title></head><body>{before}{main}{after}</body></html>"


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><h1>A &amp; b</h1><p>One<br>two\n  three<p>Four <b>five</article><footer>x</footer>", "A & b\nOne two three\nFour five"),
        ("<nav><a>Menu</a></nav><article><p>x</p><aside>side</aside><div class='post-comments'>c</div><form>f</form><p>y</article>", "x\ny"),
        ("<script>var t='<article>no</article>'</script><style>p{}</style><main><p>in</p><!-- <p>no</p> --></main>", "in"),
        ("<article><p>a &lt; b &#233; &nbsp; c &am</p><p>  </p><ul><li>l1<li>l2</ul><table><tr><td>t1<td>t2</table>", "a < b é c &am\nl1\nl2\nt1\nt2"),
        ("<article><p>cut off <foot", "cut off"),
        ("<article><p>1 < 2 and <3 </p><div id='ad-1'>buy</div><div hidden>h</div><div style='display: none'>d</div></article>", "1 < 2 and <3"),
        ("<article><p class='ad'>buy<p>text</article>", "text"),
        ('<article><p title="a > b">q</p><textarea>x</textarea><button>b</button></article>', "q"),
        ('<p title="a hidden ad">outside</p><main><p>m</p><article><p alt="hidden">in <span class="ad">buy</span> line</p></article></main>', "in line"),
        ("<article><p>x</p><section id='comments'><article>c1</article></section></article><article class='comment'>c2</article>", "x"),
        ("", ""),
        (None, ""),
    ],
)
def test_one_page(spark, html, text):
    table = spark.createDataFrame([(1, "http://h/x", html, 5)], "page_id long, url string, html string, n_chars int")
    r = html_text.main_text(table).first()
    assert (r.text, r.n_chars, r.url) == (text, len(text), "http://h/x")


@pytest.mark.parametrize(
    "html,text",
    [
        ("<main><p>the story</p><aside><article>teaser</article></aside></main>", "the story"),
        ("<main><p>the story is here</p></main><aside><article>teaser</article></aside>", "the story is here"),
        ("<main><p>a long story of the page</p><article>teaser</article></main>", "a long story of the page\nteaser"),
        ("<main><p>a long story of the page</p></main><article>teaser</article>", "a long story of the page"),
        ("<form><nav>menu</nav><article><p>story</p><form>f</form></article></form>", "story"),
        ("<div class='content no-sidebar'><article>story</article></div>", "story"),
        ("<div class='has-nav'><p>x</p><main>story</main></div>", "story"),
        ("<div class='page widget'><nav>m</nav><main><p>the story</p><div class='share'>s</div></main></div><p>tail</p>", "the story"),
        ("<p>the story</p><div class='related'><article>one</article></div>", "the story"),
        ("<p>story</p><div id='comments'><article>a much longer comment</article></div>", "story"),
    ],
)
def test_main_elements_and_what_is_around_them(html, text):
    found, level = html_text.blocks(html)
    kept = [t for t, at, bad in found if not bad and (not level or at & level)]
    assert "\n".join(kept) == text and (not level or html_text._article(found, level) == text)


def test_host_boilerplate_in_pages_without_article(spark):
    rnd = random.Random(9)
    bar = sentence(rnd, 12)
    bodies = [sentence(rnd, 30) for _ in range(6)]
    rows = [(i, f"https://one.org/{i}", page(f"<div>{bar}</div><div>{b}</div>")) for i, b in enumerate(bodies)]
    rows += [(10, "https://two.org/a", page(f"<div>{bar}</div><div>{bodies[0]}</div>")), (11, None, "plain words"), (11, None, "plain words"), (12, "x", None)]
    rows.append((20, "https://one.org/z", page(f"<nav>{bar}</nav><article>{bar}</article>")))
    got = {}
    for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_boilerplate == (12 if r.page_id < 6 or r.page_id == 20 else 0)
    assert got[20] == [bar]
    assert [got[i] for i in range(6)] == [[b] for b in bodies]
    assert got[10] == [f"{bar}\n{bodies[0]}"] and got[11] == ["plain words"] * 2 and got[12] == [""]


def brute_blocks(articles, least, run):
    """Per article the blocks left without runs that ``least`` and more than half of the articles have."""
    def runs(blocks):
        for i in range(len(blocks)):
            for j in range(i + 1, len(blocks) + 1):
                if sum(len(b.split()) for b in blocks[i:j]) >= run:
                    yield i, j, tuple(blocks[i:j])
                    break

    different = {tuple(a) for a in articles}
    having = {}
    for a in different:
        for r in {r for _, _, r in runs(a)}:
            having[r] = having.get(r, 0) + 1
    out = []
    for a in articles:
        cut = {k for i, j, r in runs(a) if having[r] >= least and 2 * having[r] > len(different) for k in range(i, j)}
        size = lambda ks: sum(len(a[k].split()) for k in ks)  # noqa: B023, E731
        out.append(list(a) if 2 * size(cut) > size(range(len(a))) else [b for k, b in enumerate(a) if k not in cut])
    return out


def test_boilerplate_inside_declared_articles(spark):
    rnd = random.Random(31)
    appeal, short, common = sentence(rnd, 12), [sentence(rnd, 5), sentence(rnd, 6)], sentence(rnd, 15)
    body = lambda: [sentence(rnd, rnd.randint(9, 30)) for _ in range(3)]
    hosts = {
        "appeal.org": [[*body(), appeal] for _ in range(6)],
        "copies.org": [body() + [appeal]] * 5 + [body()],  # a copied article, not boilerplate
        "two.org": [[*body(), appeal] for _ in range(2)],
        "some.org": [[*body(), common] if i < 4 else body() for i in range(9)],  # in fewer than half
        "short.org": [[short[0], short[1], *body()] for _ in range(4)],
        "edited.org": [[appeal, common, f"{sentence(rnd, 4)}"] for _ in range(4)],  # edited copies stay whole
    }
    for n in range(4):
        shared = [sentence(rnd, rnd.randint(3, 10)) for _ in range(4)]
        hosts[f"mixed{n}.org"] = [[*body(), *rnd.sample(shared, 3), sentence(rnd, 20)] for _ in range(7)]
    rows, expected = [], {}
    for host, articles in hosts.items():
        for article, left in zip(articles, brute_blocks(articles, 3, 8)):
            expected[len(rows)] = "\n".join(left)
            rows.append((len(rows), f"https://{host}/{len(rows)}", page("<article>" + "".join(f"<p>{b}</p>" for b in article) + "</article>", "<nav>menu</nav>")))
    rows.append((len(rows), *rows[0][1:]))
    expected[len(rows) - 1] = expected[0]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert {i: r.text for i, r in got.items()} == expected
    assert all(appeal not in got[i].text and got[i].n_boilerplate == 12 for i in range(6)) and appeal in got[6].text
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_unclosed_and_deep_markup_ends():
    assert html_text.blocks("<b>" * 20_000 + "x" + "</i>" * 20_000)[0] == [("x", 0, False)]
    assert html_text.blocks("<article>" + "<" * 20_000 + 'a href="' * 200)[1] == 2
    assert html_text.blocks("<!-- open")[0] == []


# ---- token files ------------------------------------------------------------------------

def test_tokens_round_trip(spark, tmp_path):
    rnd = random.Random(10)
    rows = [(i, sentence(rnd, rnd.randint(0, 50)).title()) for i in range(200)] + [(300, "a  b\n c\t\t d"), (301, " lead"), (302, "tail "), (303, "\0 \0x"), (304, "<|endoftext|>"), *AWKWARD]
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(docs(spark, rows).repartition(5), path, public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    start = 0
    got = sorted(token_orc.token_report(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id or -1 for r in got] == sorted(i or -1 for i, _ in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        options = [np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for t in texts[r.doc_id]]
        assert (r.start, (r.n_tokens, r.ids_crc32)) == (start, next((len(o), zlib.crc32(o.tobytes())) for o in options if len(o) == r.n_tokens))
        start += r.n_tokens
    one = token_orc.read_tokens(spark, path).where("doc_id = 150")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,150)]" in one._jdf.queryExecution().toString()


def test_words_are_remembered_without_what_follows_them():
    """A word is one piece whatever stands behind it, and the ids are those of the whole text."""
    rnd = random.Random(41)
    names = [f"{a}{b}{c}" for a in "kmtz" for b in ("lo", "né", "RU") for c in ("ga", "ß", "x")]
    parts = [*names, ",", ".", "'s", "'t", "'", "\"", "7", "42", "é", "e\u0301", "\n", "\t", " ", "  ", "\u00a0", "\u3000", "\x7f", "\0", "-", "漢", "🙂", "’s", "_", "don't", "I'VE"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    coder = token_orc.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def encoded(texts):
        raw = [t.encode() for t in texts]
        ids, lengths = coder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]

    words_alone = [w for w in names if w.isascii()]
    sentences = [f"{w}{end} {w}{end}" for w in words_alone for end in (",", ".", "!", "?", ";", ":", ")", "7")]
    assert encoded(sentences) == [plain.encode(t, add_special_tokens=False).ids + [0] for t in sentences]
    assert len(coder.keys) <= 2 * len(words_alone) + 8
    assert encoded(texts) == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_no_documents_give_no_tokens(spark, tmp_path):
    path = str(tmp_path / "none")
    token_orc.write_tokens(docs(spark, []), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_orc.token_report(spark, path).count() == 0


# ---- toxicity ---------------------------------------------------------------------------

def labelled(spark, n=900):
    rnd = random.Random(11)
    bad = ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        w = sentence(rnd, rnd.randint(5, 120)).split()
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_columns(spark):
    rows, labels, table = labelled(spark)
    model = toxicity.fit(docs(spark, rows), table)
    got = toxicity.score(docs(spark, rows + AWKWARD), model).collect()
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    out = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id > 10]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    empty = [r for r in got if r.doc_id in (1, 2, 3)][-3:]
    assert all(r.predicted == 0 for r in empty)
    rest = toxicity.without_toxic(docs(spark, rows), model)
    assert rest.columns == docs(spark, []).columns and 0.6 * len(rows) < rest.count() < 0.95 * len(rows)


def test_held_out_labels_are_not_learned(spark):
    rows, labels, table = labelled(spark, 300)
    hidden = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a = toxicity.score(docs(spark, rows), toxicity.fit(docs(spark, rows), table)).collect()
    b = toxicity.score(docs(spark, rows), toxicity.fit(docs(spark, rows), spark.createDataFrame(hidden, table.schema))).collect()
    assert [r.score for r in a] == pytest.approx([r.score for r in b])


def test_counts_grow_with_the_labels(spark):
    rows, labels, _ = labelled(spark, 600)
    # a word that one toxic row outside the held-out fifth in fifty has
    rows = [(i, t + " zzrare" * 3) if y and i % 50 < 6 else (i, t) for (i, t), (_, y) in zip(rows, labels)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), table, fit_rows=200)
    learned = {w for (i, t) in rows if zlib.crc32(str(i).encode()) % 5 for w in t.split()}
    assert len(model.words) > 0.85 * len(learned)
    few = toxicity.fit(docs(spark, rows), table, fit_rows=200, entries=40)
    assert few.rare_words is not None and len(few.words) <= 40 and len(few.words) + few.rare_words.count() == len(model.words)
    table = docs(spark, rows + rows[:9] + AWKWARD)
    a, b = (sorted((r.doc_id or -1, r.held_out, r.score, r.predicted) for r in toxicity.score(table, m).collect()) for m in (model, few))
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b]) and [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b]
    a, b = (toxicity.without_toxic(table, m) for m in (model, few))
    assert a.columns == b.columns == table.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_one_class_or_no_labels(spark):
    rows = [(i, "some words here") for i in range(30)]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(i, 0) for i in range(30)] + [(5, None), (None, 1)], none.schema)):
        model = toxicity.fit(docs(spark, rows), labels)
        assert all(r.predicted == 0 for r in toxicity.score(docs(spark, rows + AWKWARD), model).collect())
    assert toxicity.score(docs(spark, []), toxicity.fit(docs(spark, []), none)).count() == 0


# ---- personal data ----------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15,
            }
            if good[kind]():
                out[kind].append(m.span())
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(12)
    parts = ["@", "a", "b.", "-", ".", "1", "2", "45", "255", "256", "+", " ", "(", ")", "4111111111111111", "é", "\n", "x@y.zz"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("9" * 100_000)["card"] == [] and pii.base_spans("a" * 100_000 + "@")["email"] == []


def test_semi_crf_adds_what_the_patterns_miss(spark):
    rnd = random.Random(13)
    rows = []
    for i in range(260):
        entity = [f"{sentence(rnd, 1)}.{rnd.randint(10, 99)}@mail{rnd.randint(1, 9)}.example.com", ".".join(str(rnd.randint(0, 255)) for _ in range(4)), f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}", f"order {rnd.randint(10, 999999)}"][i % 4]
        rows.append((i, f"{sentence(rnd, 12)} {entity} {sentence(rnd, 9)}"))
    hidden = [(1000, "write to bob.smith.12 [at] mail7.example.com today"), (1001, "ring (017) 555-7713 now"), (1002, "released 2021-05-06 as 1.2.3")]
    weights = pii.fit(docs(spark, rows), fit_rows=10_000)
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, rows + hidden), weights).collect()}
    for i, text in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, spans in plain_spans(text).items() for a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[i].spans.split(","))
        assert got[i].n_email == base.count("email") and got[i].n_phone == base.count("phone")
    assert got[1000].spans == "email:9:44" and got[1001].spans == "phone:5:19" and got[1002].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, hidden), weights).collect()}
    assert clean[1000] == "write to <email> today" and clean[1002] == hidden[2][1]


def test_personal_data_of_awkward_rows(spark):
    weights = pii.fit(docs(spark, AWKWARD))
    got = pii.personal_data(docs(spark, AWKWARD), weights).collect()
    assert len(got) == len(AWKWARD) and all(r.spans == "" and r.n_card == 0 for r in got)
    assert pii.personal_data(docs(spark, []), pii.fit(docs(spark, []))).count() == 0
    assert [r.text for r in pii.redact(docs(spark, [(1, None), (2, "")]), weights).collect()] == [None, ""]


def test_ratios_by_hand(spark):
    """Kneser-Ney ratios of words and bigrams, written from their definition."""
    rnd = random.Random(21)
    texts = [(rnd.random() < 0.4, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9)))) for _ in range(60)]
    words, pairs = toxicity._ratio_tables(cut_lineage(toxicity._counts(spark.createDataFrame(texts, "toxic boolean, text string").repartition(3))))
    count = {True: {}, False: {}}
    for kind, text in texts:
        w = text.split()
        for pair in zip(["<s>", *w], w):
            count[kind][pair] = count[kind].get(pair, 0) + 1
    every = set(count[True]) | set(count[False])
    hashed = lambda t: int(next(toxicity._tokens(pa.array([t])))[0][0])
    number = {c: hashed(c) for c in "abcdefg"} | {"<s>": int(toxicity.START)}
    # in how many contexts a class has a word
    seen = {k: {w: sum(b == w for _, b in count[k]) for w in "abcdefg"} for k in (True, False)}
    whole = {k: sum(seen[k].values()) for k in seen}
    got_words = {r.key: r for r in words.collect()}
    got_pairs = {r.key & ((1 << 64) - 1): r for r in pairs.collect()}
    for i, d in enumerate(toxicity.DISCOUNTS):
        both = {w: seen[True][w] + seen[False][w] for w in "abcdefg"}
        left = 1 - sum(max(c - d, 0) for c in both.values()) / sum(both.values())
        p = {k: {w: max(seen[k][w] - d, 0) / whole[k] + left * both[w] / sum(both.values()) for w in both} for k in seen}
        for w in "abcdefg":
            assert got_words[number[w]][f"r{i}"] == pytest.approx(math.log(p[True][w] / p[False][w]))
        for u, w in every:
            after = {k: sum(n for (a, _), n in count[k].items() if a == u) for k in count}
            here = {k: count[k].get((u, w), 0) for k in count}
            row = got_pairs.get(number[u] << 32 | number[w])
            value = row and row[f"r{i}"]
            if min(after.values()) == 0 or max(here.values()) <= d:
                assert value is None
                continue
            total = [count[True].get(b, 0) + count[False].get(b, 0) for b in every if b[0] == u]
            behind = 1 - sum(max(c - d, 0) for c in total) / sum(total)
            q = {k: max(here[k] - d, 0) / after[k] + behind * p[k][w] for k in count}
            assert value == pytest.approx(math.log(q[True] / q[False]))


def test_ratios_with_and_without_joins(spark):
    """Words and contexts go to tasks as packed arrays; joined beyond a bound, the ratios are the same."""
    rnd = random.Random(22)
    texts = [(rnd.random() < 0.4, " ".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(1, 9)))) for _ in range(90)]
    texts += [(True, "only toxic"), (False, "only other"), (True, None), (False, "")]
    bigrams = cut_lineage(toxicity._counts(spark.createDataFrame(texts, "toxic boolean, text string").repartition(3)))
    sent, joined = (toxicity._ratio_tables(bigrams, sent=n) for n in (toxicity.BROADCAST_IDS, 0))
    for a, b in zip(sent, joined):
        assert a.columns == b.columns and a.count() > 10
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    key, *counts = toxicity._packed(spark.createDataFrame([((1 << 32) - 1, 5, 6), (7, 1, 2)], "w long, t long, o long"))
    assert key.tolist() == [7, (1 << 32) - 1] and [c.tolist() for c in counts] == [[1, 5], [2, 6]]
    assert sum(c.nbytes for c in (key, *counts)) == 2 * 12
