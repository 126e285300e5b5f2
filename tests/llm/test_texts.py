"""Operators that look at each row alone: secrets, HTML, tokens, language."""

import base64
import hashlib
import json
import random
import re
import time

import numpy as np
import pytest

from cellweave.llm import decontaminate, html_text, language_id, secrets, token_count


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2)
    return bytes([tag]) + size + body


KEY = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48") + der(0x05, b"")) + der(0x04, bytes(range(200))))
SSH = b"".join(len(p).to_bytes(4) + p for p in (b"ssh-ed25519", bytes(range(32))))
OPENSSH = b"openssh-key-v1\0" + b"".join(len(p).to_bytes(4) + p for p in (b"none", b"none", b"")) + (1).to_bytes(4) + b"".join(
    len(p).to_bytes(4) + p for p in (SSH, b"p" * 60)
)


def b64url(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def test_structures():
    assert secrets.is_der(KEY) and not secrets.is_der(KEY[:-1]) and not secrets.is_der(KEY + b"\0")
    assert not secrets.is_der(KEY[:20] + b"\xff" + KEY[21:3]) and not secrets.is_der(b"")
    assert secrets.is_ssh(SSH) and secrets.is_ssh(OPENSSH) and not secrets.is_ssh(SSH[:-1]) and not secrets.is_ssh(b"\0\0\0\5hello")


def test_secret_spans(table_of):
    jwt = ".".join([b64url(json.dumps({"alg": "HS256"}).encode()), b64url(b'{"sub":1}'), b64url(b"s" * 32)])
    pem = "-----BEGIN KEY-----\n" + "\n".join(re.findall(".{1,64}", base64.b64encode(KEY).decode())) + "\n-----END KEY-----"
    fake = b64url(b'{"typ":"x"}') + "." + b64url(b"{}") + "." + b64url(b"s" * 32)
    texts = {
        1: f"é {jwt} {fake}", 2: f"x\n{pem}\n", 3: f"hex {KEY.hex()} 00", 4: f"ssh {base64.b64encode(SSH).decode()} me",
        5: "ApI_Key: 'abcdefghijkl' token = short secret=secret=abcdefghijklm", 6: "AKIA" + "A" * 14 + " AKIA" + "B" * 13, 7: None, 8: "",
        9: "𝕏 0123456789abcdef0", 10: "paſſword = abcdefghijklmnop", 11: "A" * 300_000,
    }
    got = {r.doc_id: r for r in secrets.scan_secrets(table_of([(k, v, None, None) for k, v in texts.items()])).collect()}
    assert got[1].spans == f"jwt:2:{2 + len(jwt)}"
    assert got[2].spans.startswith("der:22:") and got[2].n_structural == 1
    assert got[3].spans == f"hex:4:{4 + 2 * len(KEY)},der:4:{4 + 2 * len(KEY)}"
    assert got[4].spans.startswith("ssh:4:")
    assert (got[5].n_assign, got[5].spans) == (2, "assign:0:22,assign:38:65")
    assert (got[6].n_access, got[6].spans) == (1, "access:0:18")
    assert got[9].spans == "hex:2:19" and got[9].base_sha256 == hashlib.sha256(b"hex:2:19").hexdigest()
    for k in (7, 8, 10, 11):
        assert got[k].spans == "" and got[k].base_sha256 == hashlib.sha256(b"").hexdigest()


def spans_of(text):
    return secrets.structural_spans(text, secrets.patterns())


def test_secrets_glued_to_other_text():
    jwt = ".".join([b64url(json.dumps({"alg": "HS256", "kid": "k" * 90}).encode()), b64url(b'{"sub":1}'), b64url(b"s" * 32)])
    bare = ".".join([b64url(b'{"alg":"none"}'), b64url(b"{}"), ""])
    body = re.findall(".{1,64}", base64.b64encode(KEY).decode())
    ssh = base64.b64encode(SSH).decode()
    for before, kind, secret in (
        ("auth.", "jwt", jwt), ("x_", "jwt", jwt), ("a.b.c.", "jwt", jwt), ("eyJ", "jwt", jwt), ("see ", "jwt", bare), ("q.", "jwt", bare),
        ("/", "der", base64.b64encode(KEY).decode()), ("AAAA", "ssh", ssh), ("x/", "ssh", base64.b64encode(OPENSSH).decode()), ("a", "der", KEY.hex()),
        ("BEGIN\n    ", "der", "\n    ".join(body)), ("BEGIN\\n", "der", "\\n".join(body)), ("BEGIN\r\n", "der", "\r\n".join(body)), ("0", "ssh", SSH.hex().upper()),
    ):
        assert spans_of(f"{before}{secret} end") == [(kind, len(before), len(before) + len(secret))], (before, kind)
    assert spans_of(jwt + "." + jwt) and spans_of(jwt[:40] + "x" + jwt[40:] + " " + base64.b64encode(KEY[:-1]).decode()) == []


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    for text in ("a" * 2_000_000 + " .", "eyJ" * 300_000 + ".e30.x", "MI" * 500_000, "30" * 300_000, "A" * 1_000_000, "ab." * 300_000, ("A" * 64 + "\n") * 20_000):
        spans_of(text)
    assert time.perf_counter() - start < 30


def brute_base(text):
    """Left to right, character by character."""
    found, digit = [], "0123456789abcdef"
    word = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    low = "".join(c.lower() if c < "\x80" else c for c in text)

    def run(at, of):
        end = at
        while end < len(text) and text[end] in of:
            end += 1
        return end

    at = 0
    while at < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if low.startswith(name, at):
                for k in (1, 0):
                    p = at + len(name)
                    if k and not (p < len(text) and text[p] in "\"'"):
                        continue
                    p = run(p + k, " ")
                    if p < len(text) and text[p] in ":=":
                        p = run(p + 1, " ")
                        p += p < len(text) and text[p] in "\"'"
                        if run(p, word) > p:
                            end = run(p, word)
                            if end - p >= 12:
                                found.append(("assign", at, end))
                            break
        at = end or at + 1
    for kind, start, of, least in (("access", "AKIA", word[:26] + "0123456789", 18), ("hex", "", digit, 16)):
        at = 0
        while at < len(text):
            end = run(at + len(start), of) if text.startswith(start, at) else at
            if end > at + len(start):
                if end - at >= least:
                    found.append((kind, at, end))
                at = end
            else:
                at += 1
    return sorted(found)


def test_base_spans_against_brute_force(odd_rows):
    rng = random.Random(21)
    bits = ["password", "PassWd", "token", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "AKIA", "AKIAZ", "0a1b2c3d", "deadbeef", "é", "x", "K9", "-", ".", "A1B2C3D4", "\n", "ſ"]
    rules = secrets.patterns()
    for text in ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)] + [r[1] or "" for r in odd_rows if len(r[1] or "") < 20_000]:
        assert sorted(secrets.base_spans(text, rules)) == brute_base(text), text


def test_secrets_of_odd_tables(table_of, odd_rows):
    assert secrets.scan_secrets(table_of(odd_rows)).count() == len(odd_rows)
    assert secrets.scan_secrets(table_of([])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site, the one.</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two.</a></li></ul></nav>
<div class="cookie-banner">We use cookies, many cookies. Do you accept them all, now?</div>%s
<aside class="sidebar">Other stories, all of them, are here. Read more!</aside><form>Sign up, please. <input></form>
<div id="comments"><p>First! What a text, I have never read one like it. Never.</p></div><footer>&copy; 2020, all rights.</footer></body></html>"""


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", '<div class="post-body">%s</div>', '<div><div id="c1">%s</div></div>'])
def test_article(frame):
    body = "<h2>A title</h2><p>The first,  long <b>bo</b>ld paragraph &amp; more, with a <a href='x'>link</a>.<p>Short.<ul><li>An item, one.<li>Two</ul><p>The last &lt;one&gt;; longer than the others, by far.</p>"
    want = "A title The first, long bold paragraph & more, with a link. Short. An item, one. Two The last <one>; longer than the others, by far."
    assert html_text.content(PAGE % (frame % body)) == want


BARE = """<body><div><div><a href=a>Home</a> <a href=b>All the news, every day</a></div><div><a href=c>About</a></div></div>
<div><div><h1>What was found</h1><p>The first paragraph, long enough to tell, has commas, and stops. It goes on; so it does.</p><p>Short.</p>
<p>Another one, as long as the first, or longer: it has all that prose has, and more. Does it? It does.</p><ul><li>One</li><li>Two</li><li>Three</li><li>Four</li></ul></div></div>
<div><b>Call now</b></div><div><p>Offer 1</p><p>Offer 2</p></div><div>Imprint</div></body>"""
BARE_TEXT = (
    "What was found The first paragraph, long enough to tell, has commas, and stops. It goes on; so it does. Short. "
    "Another one, as long as the first, or longer: it has all that prose has, and more. Does it? It does. One Two Three Four"
)


def test_path_scores_decide_where_no_name_tells(monkeypatch):
    """No article, main, class or id: with flat ratios, no smoothing, no threshold or no fusing another text comes out."""
    assert html_text.content(BARE) == BARE_TEXT
    ratios = html_text.path_ratios
    for name, broken in (("path_ratios", lambda nodes: dict.fromkeys(ratios(nodes), 1.0)), ("LEVEL", 0.0), ("smooth", lambda x: [0.0] * len(x)),
                         ("fuse", lambda nodes, scores: [scores[b.path] for b, _, _ in nodes])):
        with monkeypatch.context() as m:
            m.setattr(html_text, name, broken)
            assert html_text.content(BARE) != BARE_TEXT, name


def test_words_inside_and_beside_an_article():
    text = "A paragraph, with commas, that is long enough. And one more sentence; so it is."
    page = f"<body><div class=siteNav><p>{text}</p></div><article><p>{text}</p><p class=notice>{text}</p><section class=related-work><p>{text}</p></section><div class=comments><p>{text}</p></div></article><div class=notice>{text}</div></body>"
    assert html_text.content(page) == " ".join([text] * 3)


def test_deep_and_unbalanced_pages_take_linear_time():
    start = time.perf_counter()
    for page in ("<div>" * 30_000 + "x, y.", "<p>" + "<b>" * 30_000 + "x, y." + "<i>a</i>" * 3000 + "</u>" * 30_000, "<p><a>" * 20_000):
        html_text.content(page)
    assert time.perf_counter() - start < 20


def test_odd_pages(spark):
    rows = [(1, "u", None, 5), (2, None, "", 5), (3, "u", "<p>", 5), (4, "u", "<div>" * 3000 + "deep, text." , 5), (5, "u", "just text, no tags", 5),
            (6, "u", "<p>un<closed <b>x</p><![if IE]><!-- c <p>y, z.", 5), (6, "u", PAGE % "<article><p>A, b.</p></article>", 5), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2, 3)} == {1: "", 2: "", 3: ""}
    assert "A, b." in [r.text for r in got]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_token_counts_match_the_library(spark, table_of, odd_rows):
    from tokenizers import Tokenizer, models, normalizers

    vocabulary = token_count.load_vocabulary()
    special = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256))]  # for the byte fallback
    library = Tokenizer(models.Unigram(special + vocabulary, 0, True))
    mark = token_count.SPACE_MARK
    library.normalizer = normalizers.Sequence([normalizers.Prepend(mark), normalizers.Replace(" ", mark)])
    texts = ["", " ", "  a  b ", "aaaa" * 40, "日本語 ሰላም x\n\ny", "𝕏𝕐 zz", "é​� ﷽", "ab" * 3000]
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    counter = token_count.Counter(vocabulary)
    for text in texts + [r.text for r in sample]:
        assert counter(text)[0] == len(library.encode(text, add_special_tokens=False).ids), text[:50]
    got = token_count.count_tokens(table_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r.n_tokens == 0 and r.score == 0 for r in got if r.doc_id in (90, 91))


def test_written_control_and_byte_pieces_are_text():
    counter = token_count.Counter(token_count.load_vocabulary())
    plain = lambda text: counter.viterbi(token_count.SPACE_MARK + text)[0]
    assert counter("a<0x0A>b")[0] == plain("a<0x0A>b") > 4 and counter("<s>")[0] > 2 and counter("</s>")[0] > 2


def test_ties_go_to_the_earliest_start():
    counter = token_count.Counter([("<unk>", -9.0), ("a", -1.0), ("aa", -2.0), ("▁", -1.0), ("ab", -3.0), ("b", -1.0)])
    assert counter.viterbi("aa") == (1, -2.0)  # one piece from the start, not two of the same score
    assert counter.viterbi("ab") == (2, -2.0)
    assert counter.viterbi("é") == (2, -19.0)  # two bytes


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and 150 < len(held) < 350
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_tables(table_of, odd_rows):
    got = language_id.identify(table_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (90, 91, 92, 93))
    assert {r.lang_pred for r in got} <= {"und", "en", "fr", "de"}
    assert language_id.identify(table_of([])).count() == 0
    unlabelled = table_of([(1, "text", None, None)])
    assert [r.lang_pred for r in language_id.identify(unlabelled).collect()] == ["und"]
    assert language_id.keep_identified(unlabelled).count() == 1
    kept = language_id.keep_identified(table_of(odd_rows))
    assert kept.columns == table_of([]).columns
    assert not {90, 91, 92, 93} & {r.doc_id for r in kept.select("doc_id").collect()}


def test_windows_do_not_mix_texts():
    rng = np.random.default_rng(0)
    net = language_id.train(rng.integers(97, 120, (64, language_id.WINDOW + language_id.TAIL)).astype(np.uint8), rng.integers(0, 2, 64), 2)
    lookup = language_id.tables(net)
    texts = [bytes(rng.integers(97, 120, n).astype(np.uint8)) for n in (1, 5, 253, 254, 256, 259, 1000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = language_id.text_probabilities(net, lookup, np.cumsum([0, *map(len, texts)]), data)
    for text, p in zip(texts, together):
        alone = language_id.text_probabilities(net, lookup, np.array([0, len(text)]), np.frombuffer(text, np.uint8))[0]
        assert np.allclose(alone, p, atol=1e-6)
        x = np.zeros((1, language_id.WINDOW + language_id.TAIL), np.uint8)
        if len(text) <= language_id.WINDOW - language_id.TAIL:
            x[0, : len(text)] = np.frombuffer(text, np.uint8)
            hidden = language_id._forward(net, x)[2]
            assert np.allclose(language_id.softmax(hidden @ net["v"] + net["c"])[0], p, atol=1e-5)


def brute_edits(item, text):
    prev = np.zeros(len(text) + 1, int)
    ramp, code = np.arange(len(text) + 1), decontaminate.codes(text)
    for c in decontaminate.codes(item):
        cur = prev + 1
        cur[1:] = np.minimum(prev[:-1] + (code != c), cur[1:])
        prev = np.minimum.accumulate(cur - ramp) + ramp
    return int(prev.min())


def edited(rng, text, k):
    text = list(text)
    for _ in range(k):
        p, kind = rng.randrange(len(text)), rng.randrange(3)
        if kind == 0:
            text[p] = rng.choice("xyz")
        elif kind == 1:
            del text[p]
        else:
            text.insert(p, rng.choice("xyz"))
    return "".join(text)


@pytest.mark.parametrize("kind", ["replace", "delete", "insert"])
def test_items_of_every_length_with_spread_edits(kind):
    """Evenly spread edits leave the fewest q-grams whole."""
    rng = random.Random(9)
    items = [(m, "".join(rng.choice("abcdefghijklmnop") for _ in range(m))) for m in range(1, 121)]
    texts = []
    for m, item in items:
        k, out = decontaminate.budget(m), list(item)
        assert m - decontaminate.gram_length(m) + 1 > decontaminate.gram_length(m) * k and decontaminate.gram_length(m) > 0
        for j in range(k):
            at = (j + 1) * m // (k + 1)
            out[at] = {"replace": "Z", "delete": "", "insert": out[at] + "Z"}[kind].lower()
        texts.append("QQQ rstuvw".lower() + "".join(out) + "rstuvw qq")
    found = {(n, i): e for n, i, e, _ in decontaminate.Matcher(items).find(texts)}
    for n, (m, _) in enumerate(items):
        assert found[n, n] <= decontaminate.budget(m)


@pytest.mark.parametrize("hits", [1 << 21, 50])
def test_decontamination_against_alignment(monkeypatch, hits):
    import random

    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(2)
    words = "the of and thing reation stour only wher ned".split()
    line = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(i, decontaminate.normal(line(rng.randrange(4, 30)))) for i in range(12)] + [(50, "ab" * 40), (51, "z" * 100)]
    texts = ["", "zzz", "ab" * 300, "z" * 500]
    for _ in range(40):
        item = rng.choice(items)[1]
        k = rng.randrange(int(1.6 * decontaminate.budget(len(item))) + 2)
        texts.append(decontaminate.normal(line(rng.randrange(8)) + edited(rng, item, k) + line(rng.randrange(8))))
    found = {(n, i): e for n, i, e, _ in decontaminate.Matcher(items).find(texts)}
    want = {}
    for n, text in enumerate(texts):
        for i, (_, item) in enumerate(items):
            e = brute_edits(item, text)
            if e <= decontaminate.budget(len(item)):
                want[n, i] = e
    assert found == want and 15 < len(want)


def test_decontamination_of_tables(spark, table_of, odd_rows, monkeypatch):
    item = odd_rows[10][1] + " " + odd_rows[11][1]
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, None, 0), (4, "short", 0), (5, "", 0)], "item_id long, text string, edits int")
    rows = [*odd_rows, (200, "before " + item.upper().replace(" ", "\n") + " after", None, None), (None, item, None, None)]
    docs = table_of(rows)
    want = sorted([(200, 1), (200, 2), (-1, 1), (-1, 2)])
    for limit in (1 << 22, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", limit)
        got = decontaminate.contaminated(docs, bench).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == want
        clean = decontaminate.without_leaks(docs, bench)
        assert clean.columns == docs.columns and clean.count() == len(rows) - 2
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.contaminated(table_of([]), bench).count() == 0
