"""WARC derivatives, secrets, top-k, url filters, mixing: against plain versions."""

from __future__ import annotations

import hashlib
import html as html_module
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqspark.llm import mixing, secrets, topk, urlfilter, warc

# --- WARC -------------------------------------------------------------------

PAGES = [
    (1, "https://a.example/x", "<html><head><title>T &amp; U</title><style>p{}</style></head><body><p>One<br>two &lt;b&gt;</p><script>var a='<p>no</p>';</script><!-- gone --></body></html>", "z"),
    (2, None, None, None),
    (3, "http://b.example/", "", "z"),
    (4, "http://c.example/ü", "plain é  text &amp;lt; 2 < 3", "z"),
    (1, "https://a.example/x", "<p>other</p>", "z"),
]
PAGE_SCHEMA = "page_id long, url string, html string, block string"


def test_warc_links_and_text(spark):
    records = warc.derive(warc.responses_from_pages(spark.createDataFrame(PAGES, PAGE_SCHEMA))).collect()
    assert len(records) == 2 * len(PAGES)
    by_id = {r["record_id"]: r for r in records}
    for r in records:
        other = by_id[r["concurrent_to"]]
        assert other["refers_to"] == r["refers_to"] and other["record_type"] != r["record_type"]
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert r["content_length"] == len(r["block"].encode())
    text = {(r["page_id"], r["target_uri"]): r["block"] for r in records if r["record_type"] == "conversion"}
    assert text[4, "http://c.example/ü"] == "plain é text &lt; 2 < 3"
    assert text[2, ""] == "" and text[3, "http://b.example/"] == ""
    blocks = [r["block"] for r in records if r["page_id"] == 1 and r["record_type"] == "conversion"]
    assert "T & U\nOne\ntwo <b>" in blocks
    fields = [r["block"] for r in records if r["record_type"] == "metadata" and "T & U" in r["block"]][0]
    assert "http-header: HTTP/1.1 200 OK\r\nhttp-header: Content-Type: text/html" in fields
    assert "source-payload-digest: sha256:" + hashlib.sha256(PAGES[0][2].encode()).hexdigest() in fields


def test_warc_round_trip(spark):
    """The bytes of the records, one behind another, give the records again."""
    records = warc.serialized(warc.derive(warc.responses_from_pages(spark.createDataFrame(PAGES, PAGE_SCHEMA)))).collect()
    data = b"".join(bytes(r["warc"]) for r in records)
    found = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(fields["Content-Length"])
        found.append((fields["WARC-Record-ID"], fields["WARC-Refers-To"], rest[:size].decode()))
        assert rest[size : size + 4] == b"\r\n\r\n"
        data = rest[size + 4 :]
    assert found == [(r["record_id"], r["refers_to"], r["block"]) for r in records]


def test_warc_text_plain_version(spark, sf_dir):
    """Another way to the same text: the standard parser's entities and a plain walk."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select("html", warc.plain_text(pages["html"]).alias("t")).collect()
    for r in rows:
        out = re.sub(warc.UNSEEN, " ", r["html"])
        out = re.sub(r"[\r\n\t\f ]+", " ", out)
        out = re.sub(warc.TAGS, "", re.sub(warc.BREAKS, "\n", out))
        out = html_module.unescape(out)
        want = "\n".join(x for x in (re.sub(" +", " ", y).strip(" ") for y in out.split("\n")) if x)
        assert r["t"] == want
    assert warc.derive(warc.responses_from_pages(pages.where("false"))).collect() == []


def test_warc_digest_is_of_the_bytes(spark):
    """Of the bytes that are there and counted, without a way through characters."""
    raw = b"<p>caf\xe9</p>"
    pages = spark.createDataFrame([(1, "http://a.example/", bytearray(raw))], "page_id long, url string, html binary")
    records = warc.derive(warc.responses_from_pages(pages.withColumn("html", F.col("html").cast("string")))).collect()
    assert {r["source_payload_digest"] for r in records} == {"sha256:" + hashlib.sha256(raw).hexdigest()}
    assert any(f"source-length: {len(raw)}\r\n" in r["block"] for r in records)


def test_warc_text_odd_pages(spark):
    """Blanks, line ends, tags and entities in any order give what the single steps give."""
    rng = random.Random(12)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\f", "\x0b", "\xa0", "a", "Zü", "<br>", "<BR\n/>", "</p >", "<b>", "</b\t>", "<hr", ">", "<!--", "-->", "<!-- x -->", "<script>", "</script >", "<STYLE a='>'>", "</style>", "<!doctype x>", "&amp;", "&lt;", "&nbsp;", "&amp;lt;", "$1", "\\", "<", "< p>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "html string").select("html", warc.plain_text(F.col("html")).alias("t")).collect()
    for r in rows:
        out = re.sub(warc.UNSEEN, " ", r["html"], flags=re.ASCII)
        out = re.sub(r"[\r\n\t\f ]+", " ", out)
        out = re.sub(warc.TAGS, "", re.sub(warc.BREAKS, "\n", out, flags=re.ASCII))
        for entity, char in warc.ENTITIES:
            out = out.replace(entity, char)
        out = re.sub(" +", " ", re.sub(r" *\n[ \n]*", "\n", out)).strip(" \n")
        assert r["t"] == out, r["html"]


# --- secrets ----------------------------------------------------------------

NAMES = r"(?i:(password|passwd|secret|token|api_?key))"
ASSIGN = re.compile(NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_base(spark):
    rng = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", "ſecret", "=", ":", " ", "  ", "\t", '"', "'", "\n", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4, "abc12345", "é", "x", "password=token=abcdefgh", "0f" * 15]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(1, "", "k")]
    found = secrets.summary(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")))
    for r in found.collect():
        want = plain_base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len([x for x in want.split(",") if x])
        assert set(x for x in want.split(",") if x) <= set(r["spans"].split(","))


def test_secrets_lexer():
    text = 'seed = "qX93-kd02PLs!"\nrest = "zz91Q"\nconn.db_pwd = seed\nauth_token := "a1" + rest + "B2c3D4"\nwidth: 12345678\npassword = "changeme"\n'
    found = {(r["kind"], text[r["start"] : r["end"]]) for r in secrets.scan_text(text) if r["kind"] in ("lexed", "propagated")}
    assert found == {("propagated", "seed"), ("propagated", '"a1" + rest + "B2c3D4"')}
    assert secrets.redact_text('x password="hunter2hunter2" y') == 'x [SECRET]" y'
    assert secrets.redact_text(None) is None and secrets.redact_text("") == ""
    # a later constant replaces the earlier one
    assert [r["kind"] for r in secrets.scan_text('a = "kd93-LLq8-zz"\na = "x"\nmy_secret = a')] == []


def test_secrets_constants_go_too():
    """The literal behind a name is reported and redacted, however often it was handed on."""
    text = 'k = "q9Xv7LmZ2pTk4Rw8"\npassword = k'
    assert secrets.redact_text(text) == 'k = "[SECRET]"\npassword = [SECRET]'
    assert {(r["kind"], text[r["start"] : r["end"]]) for r in secrets.scan_text(text)} == {("propagated", "k"), ("constant", "q9Xv7LmZ2pTk4Rw8")}
    text = 'a = "q9Xv7LmZ"\nb = a + "2pTk4Rw8"\nc = b\nfine = "unrelated words"\nmy_secret = c\ndb_pwd = c\nn = d0Lw93kzQx71\nauth_token = n'
    clean = secrets.redact_text(text)
    assert not any(x in clean for x in ("q9Xv7LmZ", "2pTk4Rw8", "d0Lw93kzQx71")) and "unrelated words" in clean
    spans = [(r["kind"], r["start"], r["end"]) for r in secrets.scan_text(text)]
    assert len(spans) == len(set(spans))


@pytest.mark.parametrize("line", [
    "let password: string = {}", "db_pwd: str = {}", "signing_key: Final = {}", "signing_key: Final[str] = {}", "db_pwd: str | None = {}",
    "db_pwd: Dict[str, str] = {}", "config: db_pwd = {}", "private_key = x = {}", "x = private_key = {}", "config: x = y = db_pwd = {}",
    "_auth = {}", "salt = {}", "session_key?: string = {}", "db_pwd: {}",
])
def test_secrets_declarations(line):
    """Types and further targets stand between a name and its literal; every listed name can be reported."""
    text = line.format('"q9Xv7LmZ2pTk4Rw8"')
    assert secrets.redact_text(text) == line.format('"[SECRET]"'), secrets.scan_text(text)


@pytest.mark.parametrize(
    "line",
    [
        'signing_key = b"{}"', 'app.secret_key = b"{}"', 'signing_key = f"{}"', 'signing_key = """{}"""', "signing_key = '''\n{}\n'''",
        'db_pwd = ("{}")', "<passphrase>{}</passphrase>", '<add key="db_pwd" value="{}"/>', '<property name="db_pwd">\n  {}\n</property>',
        'signing_key=\n  "{}"', 'db_pwd = os.getenv("DB_PWD_NAME_1", "{}")', 'db_pwd = env.get("DB_PWD", default="{}")', 'db_pwd = os.environ.get("X") or "{}"',
        "db_pwd: |\n  {}\nnext: 5", 'db_pwd = new SecureString("{}")', "z" * 300 + '_pwd = "{}"',
    ],
)
def test_secrets_forms_of_values(line):
    text = line.format("q9Xv7LmZ2pTk4Rw8")
    assert secrets.redact_text(text) == line.format("[SECRET]"), secrets.scan_text(text)


def test_secrets_of_several_literals():
    assert secrets.redact_text('db_pwd = "q9Xv7LmZ" "2pTk4Rw8"\nx') == "db_pwd = [SECRET]\nx"
    assert secrets.redact_text('db_pwd = ("q9Xv7LmZ"\n  "2pTk4Rw8")') == "db_pwd = ([SECRET])"
    assert secrets.redact_text('db_pwd = ["q9Xv7LmZ2pTk4Rw8", "a9Xv7LmZ2pTk4Rw7"]') == 'db_pwd = ["[SECRET]", "[SECRET]"]'
    key = "signing_key: |\n  MIIEpAIBAAKCAQEA7bq\n  q9Xv7LmZ2pTk4Rw8aaa\nnext: 5"
    assert secrets.redact_text(key) == "signing_key: |\n  [SECRET]\nnext: 5"


def test_secrets_phrases_and_what_is_none():
    assert secrets.redact_text('passphrase = "correct horse battery staple"') == 'passphrase = "[SECRET]"'
    for text in (
        'db_pwd = getpass("Enter your pass word here")', 'pwd: "The words do not match"', 'signing_key = load("a")', "db_pwd = settings[0]",
        'db_pwd = os.getenv("DB_PWD_NAME_17")', "<passphrase></passphrase>", "db_pwd: |\n", 'db_pwd = "', 'db_pwd = """', "db_pwd = (", "db_pwd = a +",
    ):
        assert secrets.scan_text(text) == [], text


def test_secrets_joined_over_and_over():
    """Constants are counts and links: doubling one ten thousand times takes the memory of its lines."""
    tracemalloc.start()
    text = 'x = "aaaa9b7c"\n' + "x = x + x\n" * 10_000 + "db_pwd = x\n"
    assert {r["kind"] for r in secrets.scan_text(text)} == {"propagated", "constant"}
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    text = 'x = "q9"\n' + "".join(f'x = x + "q{i}"\n' for i in range(3000)) + "db_pwd = x\n" * 300
    assert sum(r["kind"] == "constant" for r in secrets.scan_text(text)) == 3001


@pytest.mark.parametrize("part", ["a.", "a=", "a=(", 'a="""', 'a=f("x",', "a: b | ", "pwd = `", "pwd =\n", "pwd = a or ", "<pwd>", "pwd=a", "pwd = "])
def test_secrets_long_repetitive_texts(part):
    started = time.process_time()
    secrets.scan_text(part * 40_000)
    assert time.process_time() - started < 20


def test_secrets_names_and_plain_values():
    for name in secrets.NAME_PARTS:
        assert "q9Xv7LmZ2pTk4Rw8" not in secrets.redact_text(f'x {name} = "q9Xv7LmZ2pTk4Rw8" y'), name
    assert secrets.redact_text("author: Jane-Smith-1975") == "author: Jane-Smith-1975"
    assert secrets.redact_text("db_pwd: q9Xv7LmZ2pTk= x = 5") == "db_pwd: [SECRET] x = 5"
    assert secrets.redact_text("db_pwd: q9Xv7LmZ2pTk4Rw8 = 5") == "db_pwd: [SECRET] = 5"
    # a constant reaches all targets of a chain
    assert "q9Xv7LmZ2pTk4Rw8" not in secrets.redact_text('a = b = "q9Xv7LmZ2pTk4Rw8"\ndb_pwd = a')


# --- top-k ------------------------------------------------------------------


def plain_top(rows, asked, k):
    good = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in good)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for q, v in good:
        if q in asked:
            scored = sorted((-int(v @ w), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 16])
def test_top_k(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 5] + 0.1 * rng.normal(size=8))]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (None, rows[1][1]), (404, [0.0] * 8), (405, [-0.001] * 8), (406, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = {i for i in range(0, 410, 20)}
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=20, block_rows=block, pivots=8)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, asked, 20)


def test_top_k_small(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id = 0"), k=20)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 7, 64 * 128)]
    assert topk.top_k(df.where("false"), df, k=20).collect() == []


def test_top_k_refuses_large_components(spark):
    """Scores are exact or there are none."""
    df = spark.createDataFrame([(0, [1.0]), (7, [3e6])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="lies beyond"):
        topk.top_k(df, df, k=20).collect()


# --- urls -------------------------------------------------------------------


def plain_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("parts", [None, 7])
def test_urls(spark, parts):
    rng = random.Random(8)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "a-example.com", "net", "x.net", "y.x.net", "org", "", "exa.mple.com", "münchen.example.com"]
    urls = [None, "", "no scheme", "http://", "https://example.com", "://a/b", "x://example.com/en/?a#b", "http://u:p@example.com:80/en/"]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/a', '/EN/', '/es/q?x://y', '#f'])}" for _ in range(300)]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("x.net", "/", "block"), ("y.x.net", "", "allow"), ("mple.com", "/", "block"), ("example.com", "/en/", "block")]
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("org", None, "block")], urlfilter.RULE_SCHEMA)
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(0, None, "h", "p")], "page_id long, url string, host string, key string")
    got = sorted(map(tuple, urlfilter.filter_urls(pages, table, parts=parts).collect()), key=str)
    want = sorted([(i, *plain_verdict(u, rules)) for i, u in enumerate(urls)] + [(0, *plain_verdict(None, rules))], key=str)
    assert got == want
    assert urlfilter.filter_urls(pages.where("false"), table).collect() == []


# --- mixing -----------------------------------------------------------------


def plain_targets(sizes, weights, share=1.5, limit=2.0):
    wanted, target, open_ = share * sum(sizes.values()), {}, dict(weights)
    while open_:
        rate = (wanted - sum(target.values())) / sum(open_.values())
        full = [s for s, w in open_.items() if w * rate >= limit * sizes[s]]
        if not full:
            target.update({s: w * rate for s, w in open_.items()})
            break
        for s in full:
            target[s] = limit * sizes[s]
            del open_[s]
    return target


@pytest.mark.parametrize("shard_words", [2_000_000, 900])
def test_mixing(spark, shard_words):
    rng = random.Random(6)
    sizes = {"a": 60, "b": 200, "c": 20, "ü": 120, None: 30}
    rows = [(f"{s}", " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 120))), s, 7) for s, n in sizes.items() for _ in range(n)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [(9000, None, "a", 7), (9001, " ", "a", 7), (None, "x y", "b", 7), (3, "x y z", "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix_sources(df, shard_words=shard_words).collect()
    assert len(got) == len(rows)
    total = {}
    for r in rows:
        total[r[2]] = total.get(r[2], 0) + len((r[1] or "").split())
    order = sorted((s for s in total if s), key=lambda s: s.encode()) + [None]
    want = plain_targets(total, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken = {}
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in total:
        assert abs(taken[s] - want[s]) < 1, s
    again = mixing.mix_sources(df.repartition(7), shard_words=shard_words).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(df.where("false")).collect() == []
    blank = mixing.mix_sources(df.where("doc_id IN (9000, 9001)")).collect()
    assert [r["taken"] for r in blank] == [0, 0]


@pytest.mark.parametrize("shard_words", [2_000_000, 7])
def test_small_sources_reach_their_targets(spark, shard_words):
    """Sources far below a block give their words, whole documents or parts of them."""
    rows = [(i, "w " * 12, f"s{i}") for i in range(60)] + [(100 + i, "w w w", "many") for i in range(10)] + [(200, "w", "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_source = {}
    for r in mixing.mix_sources(df, shard_words=shard_words).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        got = by_source.setdefault(r["source"], [0, r["target"]])
        got[0] += r["taken"]
    assert all(abs(n - target) < 1 for n, target in by_source.values()) and len(by_source) == 62


def test_sainte_lague(spark):
    """Quotas are those of dealing block by block to the highest quotient."""
    rng = random.Random(1)
    shards = [(s, k, rng.choice([1, 5, 40, 700, 9000, 100_000]), rng_n) for s, rng_n in (("a", 37), ("b", 4), ("c", 0), (None, 500)) for k in range(9)]
    got = {(r["source"], r["shard"]): r["quota"] for r in mixing.apportion(spark.createDataFrame(shards, "source string, shard long, shard_words long, wanted long")).collect()}
    for s, n in (("a", 37), ("b", 4), ("c", 0), (None, 500)):
        mine = {k: w for t, k, w, _ in shards if t == s}
        seats = dict.fromkeys(mine, 0)
        for _ in range(n):
            best = max(mine, key=lambda k: (mine[k] / (2 * seats[k] + 1), -k))
            seats[best] += 1
        assert {k: got[s, k] for k in mine} == seats
