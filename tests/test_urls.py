from pyspark.sql import functions as F

from lodescan.functions import urls as U


def test_normalize(column):
    cases = {
        None: None,
        "": None,
        "   ": None,
        "example.com": "https://example.com/",
        "  HTTP://WWW.Example.com:80  ": "http://www.example.com/",
        "https://a.com:8443/X?q=1#f": "https://a.com:8443/X?q=1#f",
        "https://a.com/a b/é": "https://a.com/a%20b/%C3%A9",
        "https://a.com/x/../y/./z/..": "https://a.com/y/",
        "https://a.com\\b\\c": "https://a.com/b/c",
        "http://a b/": None,
        "https://a.com:99999/": None,
        "javascript:void(0)": None,
        "https:///x.com/p": "https://x.com/p",
    }
    assert column(U.normalize_url, list(cases)) == list(cases.values())


def test_page_key_merges_variants(column):
    same = ["http://www.a.com/P/", "https://a.com/p", "https://a.com:444/p//?q#f"]
    assert set(column(U.page_key, same)) == {"a.com/p"}
    assert column(U.page_key, ["https://www.a.com", "nope"]) == ["a.com/", "nope"]


def test_parts(column):
    urls = ["https://www.A.com:443/x", "http://a.com:8080", "bad"]
    assert column(U.origin_of, urls) == ["https://www.a.com", "http://a.com:8080", "bad"]
    assert column(U.site_key, urls) == ["a.com", "a.com", None]
    assert column(U.path_or_root, urls) == ["/x", "/", "bad"]
    assert column(U.safe_host, urls) == ["www.a.com", "a.com:8080", "bad"]


def test_same_origin_is_strict(column):
    base = F.lit("https://a.com/x")
    urls = ["https://a.com/y", "http://a.com/y", "https://www.a.com/y", "bad", None]
    assert column(lambda c: U.same_origin(c, base), urls) == [True, False, False, False, False]


def test_asset_and_low_value(column):
    paths = ["/a.PNG", "/a.jpeg", "/a.woff2", "/a.png/", "/a.pngx", "/feed/", "/feed", "/x/Tag/y", None]
    assert column(U.is_asset, paths) == [True, True, True] + [False] * 6
    assert column(U.is_low_value_path, paths) == [False] * 5 + [True, False, True, False]


def test_resolve_link(column):
    base = F.lit("https://a.com/x/y?q#f")
    cases = {
        "/z": "https://a.com/z",
        "z": "https://a.com/x/z",
        "../z": "https://a.com/z",
        "../../../z/": "https://a.com/z/",
        "./": "https://a.com/x/",
        "?a=1": "https://a.com/x/y?a=1",
        "//b.com/q": "https://b.com/q",
        "HTTP://B.com/Q/": "http://b.com/Q/",
        "https:foo": "https://a.com/x/foo",
        "mailto:x@y": "mailto:x@y",
        "  /t ": "https://a.com/t",
        "http://": None,
    }
    assert column(lambda c: U.resolve_link(c, base), list(cases)) == list(cases.values())
