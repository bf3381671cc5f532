"""Pages, URLs, robots rules, redaction and settings, case by case."""

import pytest

from pagespan import config
from pagespan.functions import html, redaction, robots, urls

KEY = "k" * 32


def page(body, url="https://example.com/page", **kw):
    out, error = html.parse_page(200, body if isinstance(body, bytes) else body.encode(), url, **kw)
    assert error == ""
    return out


def test_full_page():
    p = page("""<!doctype html><html><head><title>A title that is long enough to be found OK here</title>
    <meta name="description" content=" some words "><meta name="viewport" content="x"><meta name="robots" content="index, follow, INDEX">
    <link rel="alternate canonical" href="/page#x"><script type=" Application/LD+JSON ">{"a":1}</script><meta property="og:title" content="T"></head>
    <body><h1>Primary <b>heading</b></h1><h2>x</h2><h3>y</h3><a href="/a">a</a><a href="b">b</a><a href="https://other.example/">c</a><a href="#z">d</a><a href="mailto:x@y">e</a>
    <img alt="x" src=1><img><img alt=" "></body></html>""", x_robots=["noindex", "googlebot: none"])
    assert p["title_status"] == "OK" and p["description"] == "some words" and p["description_status"] == "Too Short"
    assert (p["h1"], p["h1_count"], p["h2_h6_status"]) == ("Primary heading", 1, "H2:1, H3:1")
    assert (p["internal_links"], p["external_links"], p["links"]) == (2, 1, 3)
    assert p["is_self_canonical"] and p["canonical_url"] == "/page#x" and p["has_json_ld"] and p["has_viewport"]
    assert (p["total_images"], p["images_missing_alt"], p["meta_robots"], p["x_robots_tag"]) == (3, 2, "index, follow", "noindex, googlebot: none")


def test_references_without_semicolon():
    text = "<title>a &amp b&amp;amp; &#38 &#x26; &ampx &quot;&foo;</title><body>x&nbsp y"
    assert (page(text)["title"], page(text)["word_count"]) == ('a & b&amp; & & &x "&foo;', 2)
    assert (page(text, bare=False)["title"], page(text, bare=False)["word_count"]) == ('a &amp b&amp; &#38 & &ampx "&foo;', 2)
    assert html.closed_references("&ampx;&am;&amp;&#0038;") == "&ampx;&am;&&"


def test_words_do_not_split_at_tags():
    assert page("<body>" + "<i>x</i>" * 1000)["word_count"] == 1
    assert page("<head><title>t</title></head>one <script>two</script>three<style>x</style> four")["word_count"] == 3


def test_templates_are_inert_and_shadow_roots_count():
    assert page("<head><template><title>x</title><h1>no</h1></template><title>t</title></head><h1>yes</h1>")["h1_count"] == 1
    p = page("<body><template shadowrootmode=' OPEN '><h1>in</h1><meta name=robots content=none><a href='/x'>l</a></template>")
    assert (p["h1"], p["internal_links"], p["meta_robots"]) == ("in", 1, "")
    assert page("<body><template shadowrootmode=bad><h1>in</h1></template>a b")["word_count"] == 2


def test_base_and_hosts():
    p = page("<head><base href='https://other.example/'><base href='/'></head><a href='x'>", url="https://example.com/")
    assert (p["internal_links"], p["external_links"]) == (0, 1)
    p = page("<a href='https://EXAMPLE.com:443/x'></a><a href='https://example.com:8443/'></a>")
    assert (p["internal_links"], p["external_links"]) == (1, 1)
    assert urls.is_self_canonical("https://xn--bcher-kva.de/a", "https://bücher.de/a")
    assert not urls.is_self_canonical("https://example.com/a/", "https://example.com/a")
    assert not urls.is_self_canonical("https://example.com/a?x=1", "https://example.com/a")


def test_metadata_in_body_is_ignored_but_robots():
    p = page("<title>t</title></head><body>a b<title>no</title><meta name=description content=x><meta name=robots content=noindex><link rel=canonical href=/x>")
    assert (p["title"], p["description"], p["meta_robots"], p["canonical_url"], p["word_count"]) == ("t", "", "noindex", "", 2)


def test_bounds_and_limits():
    p = page(f"<title>{'é' * 525}</title><h1>{'x' * 1025}</h1>")
    assert p["title_truncated"] and p["title_original_length"] == 525 and len(p["title"]) == 500 and p["title_status"] == "Too Long"
    assert p["h1_original_length"] == 1025
    assert html.parse_page(200, b"123456", "https://a.example/", max_body=5)[1] == "response body exceeds configured limit of 5 bytes"
    assert html.parse_page(200, b"<script>" + b"x" * 1024, "https://a.example/", max_token=256)[1] == "HTML token exceeds configured limit of 256 bytes"
    out, error = html.parse_page(404, b"<title>x</title>", "https://a.example/", x_robots=["noindex"])
    assert (out["x_robots_tag"], out["title"], error) == ("noindex", "", "")


def test_charset_and_content_type():
    assert page(b"<title>caf\xe9</title>", content_type="text/html; charset=iso-8859-1")["title"] == "café"
    assert html.content_type_is_html("text/html; charset=utf-8") and html.content_type_is_html("application/xhtml+xml")
    assert not html.content_type_is_html("application/json; profile=text/html") and not html.content_type_is_html("text/html garbage")


@pytest.mark.parametrize(("rules", "path", "allowed"), [
    ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/c", False),
    ("User-agent: *\nDisallow: /\n\nUser-agent: Bot\nAllow: /", "/x", True), ("User-agent: Bo\nDisallow: /", "/x", True),
    ("User-agent: *\nDisallow: /%64%61%74%61", "/data", False), ("User-agent: *\nDisallow: /data", "/%64ata", False), ("User-agent: *\nDisallow: /a%2ab", "/axb", True),
    ("User-agent: *\nDisallow: /é", "/%c3%a9", False), ("User-agent: *\nDisallow: /", "/robots.txt?x", True), ("User-agent: *\nDisallow: /", "/robots.txt/b", False),
    ("User-agent: *\nAllow: /p\nDisallow: /p", "/p", True), ("user-agent: *\rdisallow: /x # c\r\n", "/x", False),
    ("User-agent: *\nDisallow: /files/*report$", "/files/a/report", False), ("User-agent: *\nDisallow: /files/*report$", "/files/report2", True), ("User-agent: *\nDisallow:", "/x", True),
    ("Disallow: /\nUser-agent: *\nDisallow: /y", "/x", True), ("User-agent: *\nDisallow: /x\nSitemap: z\nUser-agent: other\nDisallow: /", "/z", True),
])
def test_robots(rules, path, allowed):
    assert robots.path_allowed(rules, "Bot/1.0", path) is allowed


@pytest.mark.parametrize(("pattern", "path", "hit"), [("/*a*a*a*a*a*a$", "/" + "a" * 150 + "b", False), ("/" + "*a" * 20 + "$", "/" + "a" * 2000 + "b", False), ("/" + "*a" * 20 + "$", "/" + "a" * 2000, True), ("/a*b*b$", "/ab", False), ("/a*b*b$", "/abxb", True), ("/a**c", "/abc", True), ("*", "/x", True), ("*$", "/x", True), ("/a*a$", "/a", False), ("/$", "/", True)])
def test_robots_patterns_take_linear_steps(spark, pattern, path, hit):
    import time

    from pyspark.sql import functions as F

    from pagespan.operators.audit import rule_matches

    rule = robots.Rule(False, pattern.removesuffix("$"), 0, pattern.endswith("$"))
    began = time.process_time()
    assert rule.matches(path) is hit and time.process_time() - began < 0.1
    df = spark.createDataFrame([((rule.pieces, rule.anchored), path)], "r struct<pieces: array<string>, anchored: boolean>, path string")
    assert df.select(rule_matches(F.col("r"), F.col("path"))).first()[0] is hit


def test_native_content_type_is_the_parsers(spark):
    from pyspark.sql import functions as F

    from pagespan.functions import native

    some = ["text/html", " TEXT/HTML ; charset=utf-8", "text/html; charset", "text/html; charset=", 'text/html; a="x y"; b=c;', "text/html garbage", "application/xhtml+xml;", "application/json; profile=text/html", "text/html;;", "text/html; =x", ""]
    got = spark.createDataFrame([(x,) for x in some], "c string").select("c", native.html_content_type(F.col("c")).alias("ok")).collect()
    assert {r.c: r.ok for r in got} == {x: html.content_type_is_html(x) for x in some}


def test_robots_limits():
    assert not robots.path_allowed("#" * (512 * 1024 + 1), "Bot", "/")
    assert robots.path_allowed("User-agent: *\n" + "Disallow: /x\n" * 2048, "Bot", "/y")
    assert [robots.status_outcome(s) for s in (200, 404, 503, 302, None)] == ["parse", "allow_all", "unavailable", "unavailable", "unavailable"]
    assert robots.request_path(urls.parse("https://a.example/private/data?q=value#f")) == "/private/data?q=value"


@pytest.mark.parametrize(("raw", "want"), [(" https://example.com/a?b=1#c ", "https://example.com/a?b=1"), ("ftp://example.com/", None), ("", None), ("https:///x", None), ("https://u:p@example.com/", None), ("http://127.0.0.1/", None), ("http://LOCALHOST:80/", None), ("http://[::1]/", None), ("http://a.example/%zz", None), ("http://a.example:x/", None), ("http://a b/", None)])
def test_targets(raw, want):
    if want is None:
        with pytest.raises(urls.UrlError):
            urls.normalize_target(raw)
    else:
        assert urls.normalize_target(raw) == want


def test_addresses():
    assert [urls.blocked_ip(x) for x in ("10.0.0.1", "8.8.8.8", "::ffff:127.0.0.1", "2001:4860:4860::8888", "169.254.169.254", "fe80::1")] == [True, False, True, False, True, True]
    assert not urls.resolved_ips_allowed([], True) and urls.resolved_ips_allowed(["8.8.8.8"], False) and not urls.resolved_ips_allowed(["8.8.8.8", "10.0.0.1"], False)
    assert urls.authority_key(urls.parse("http://EXAMPLE.com.:80/")) == "example.com"
    assert str(urls.resolve(urls.parse("https://a.example/b/c?d"), urls.parse("../x/./y"))) == "https://a.example/x/y"


def test_redaction():
    assert redaction.redact_url("https://u:p@a.example/x?b=2&Access_Token=1&b=3#f") == "https://a.example/x?Access_Token=%5BREDACTED%5D&b=%5BVALUE%5D"
    assert redaction.redact_url("  ") == "" and redaction.redact_url("http://a.example/%zz") == "[invalid-url]"
    assert redaction.redact_text('Get "https://a.example/?q=1": see https://b.example/x#y).') == 'Get "https://a.example/?q=%5BVALUE%5D": see https://b.example/x).'
    assert redaction.sanitize_error("é" * 600) == "é" * 500 + "..."


def test_config():
    c = config.load({"TARGET_FINGERPRINT_KEY": KEY})
    assert c["WORKERS"] == 3 and c["TARGET_LEASE_DURATION"] == 120_000 and c["MAX_HTML_BODY_BYTES"] == 5 << 20
    for bad in ({"WORKERS": "33"}, {"WORKERS": "x"}, {"HTTP_ATTEMPT_TIMEOUT": "30s"}, {"RUN_ID": "x"}, {"RETRY_MAX_DELAY": "25s"}, {"STOP_GRACE_PERIOD": "10s"}, {"WORKERS": "32", "MAX_HTML_TOKEN_BYTES": str(1 << 20)}, {"TARGET_FINGERPRINT_KEY": "short"}, {"LOG_LEVEL": "loud"}):
        with pytest.raises(config.ConfigError):
            config.load({"TARGET_FINGERPRINT_KEY": KEY} | bad)
