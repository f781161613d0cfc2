from lodescan.functions import html as H


def test_strip_to_text(column):
    cases = {
        "<p>a</p><script>var x='</p>';</script> b": "a b",
        "<SCRIPT x>1\n2</SCRIPT>c<style>d</style>": "c",
        "a  b\t\nc": "a b c",
        " a  b　": "a b",
        "a < b > c": "a c",
        "x<!-- hidden -->y": "x y",
        "": "",
    }
    assert column(H.strip_to_text, list(cases)) == list(cases.values())


def test_title(column):
    pages = ["<TITLE a='b'> \n Hi </TITLE><title>no</title>", "<p>x</p>", "<title></title>"]
    assert column(H.page_title, pages) == ["Hi", "", ""]


def ld(body):
    return f'<script type="application/ld+json">{body}</script>'


def test_schema_types_tree(column):
    cases = [
        (ld('{"@graph":[{"@type":"A","x":{"@type":["B","C"]}},{"@type":"A"}]}'), ["A", "B", "C"]),
        (ld('{"@type":"A",'), []),
        (ld('{"@type":"A"} tail') + ld(' {"@type":"B"} '), ["B"]),
        (ld('{"@type":"A"},{"@type":"B"}'), []),
        (ld('{"@type":"","x":[{"@type":["",null]}]}'), [""]),
        (ld('{"name":"say \\"@type\\":\\"No\\"","@type":"Caf\\u00e9"}'), ["Café"]),
        (ld('{"@type":"A","@type":"B"}'), ["B"]),
        (ld(""), []),
        ("<p>none</p>", []),
    ]
    assert column(H.schema_types_tree, [c[0] for c in cases]) == [c[1] for c in cases]


def test_schema_types_regex_sees_scalars_only(column):
    html = ld('{"@type":["X","Y"]}') + ld('broken "@TYPE" : "FAQPage" "@type":"Menu" "@type":"Menu"')
    assert column(H.schema_types_regex, [html]) == [["FAQPage", "Menu"]]
    many = "".join(ld(f'{{"@type":"T{i}"}}') for i in range(20))
    assert column(H.schema_types_regex, [many]) == [[f"T{i}" for i in range(20)]]


def test_meta_description(column):
    long = "x" * 20
    pages = [
        f'<meta name="description" content="{long}">',
        f"<META class='a' NAME='description' lang='x' content='{long}'>",
        f'<meta content="{long}" name="description">',
        '<meta name="description" content="short">',
        f'<meta name="description"><p content="{long}">',
    ]
    assert column(H.has_meta_description, pages) == [True, True, False, False, False]


def test_images(column):
    html = '<img src=a alt=""><IMG alt = "b"><img data-altx="1"><imgx alt=""><img salt="1"><img data-alt="">'
    assert column(H.img_count, [html]) == [5]
    # "data-alt" ends in a word boundary before "alt", as in the browser's own matching
    assert column(H.img_with_alt, [html]) == [3]


def test_retail_uses_ascii_boundaries(column):
    pages = ["Our shop.", "workshop", "éshop", "SHOP", "prints2", "print", "gift", "a store_x", ""]
    assert column(H.retail_hint, pages) == [True, False, True, True, False, True, True, False, False]


def test_platform_order(column):
    pages = ["x wp-content cdn.shopify", "CDN.Shopify", "_wixcss", "Squarespace", "cdnxshopify", ""]
    expected = ["WordPress", "Shopify", "Wix", "Squarespace", "unknown", "unknown"]
    assert column(H.platform, pages) == expected


def test_product_evidence(column):
    pages = [
        '"@type" : "Product" add-to-cart add_to_cart Add to Cart',
        "/product/" * 9,
        "/shop/ /shop/a /products/",
        "nothing",
    ]
    assert column(H.product_evidence, pages) == [4, 5, 2, 0]


def test_question_headings(column):
    html = (
        "<h2><span>Why?</span></h2><h3>No</h3><H4> Who <b>is</b>?\n</H4><h5>Skip?</h5>"
        "<h2>Mixed?</h3><h1>Top?</h1>"
    )
    assert column(H.question_heading_count, [html, ""]) == [3, 0]


def test_forms(column):
    pages = ["<form><input><select>", "<form><input>", "<input><input>", "<formula><input><input>"]
    assert column(H.is_form_page, pages) == [True, False, False, False]
    assert column(H.field_count, pages) == [2, 1, 2, 2]


def test_newest_year(column):
    texts = {
        "2019 and 2024": 2024,
        "$2028.0": None,
        "12020": None,
        "2025.": None,
        "v3.2024": None,
        "2011/2012": 2012,
        "2009 2030": None,
        "2021$ 2019": 2021,
        "": None,
    }
    assert column(H.newest_year, list(texts)) == list(texts.values())


def test_flags(column):
    page = (
        "<link rel='canonical' href='/'><meta name=\"robots\" content=\"noindex\">"
        "<a href='mailto:a'>a</a><a href=\"tel:1\"></a> property='og:x' name=\"viewport\""
    )
    for flag in (H.has_canonical, H.has_noindex, H.has_mailto, H.has_tel, H.has_og, H.has_viewport):
        assert column(flag, [page, "", None]) == [True, False, False]
    assert column(H.has_geo, ['"geo" :', "GEOCOORDINATES", '"geography":']) == [True, True, False]
    assert column(H.has_breadcrumb, ["BreadCrumbs", "bread crumb"]) == [True, False]
    assert column(H.has_commerce_platform, ["X-WooCommerce", "cdn-shopify"]) == [True, False]


def test_link_hrefs(column):
    html = "<a href='/a'>x</a><abbr href='/no'><A class=b HREF = \"/b\"><a data-href='/c'><a href='/d#e'>"
    assert column(H.link_hrefs, [html]) == [["/a", "/b", "/c"]]


def test_sitemap_locs(column):
    xml = "<LOC>  https://a.com/x \n</LOC><loc>two words</loc><loc></loc>"
    assert column(H.sitemap_locs, [xml]) == [["https://a.com/x"]]


def test_brackets_in_names_and_repeated_keys(column):
    def page(body):
        return f'<script type="application/ld+json">{body}</script>'

    assert column(H.schema_types_tree, [
        page('{"@type":["A]x","B[y"]}'), page('{"@type":"A","@type":"B"}'),
        page('{"@graph":[{"@type":"A","@type":["B","C"]},{"@type":"D"}]}'),
        page('{"name":"\\"@type\\":\\"no\\"","@type":"E"}'),
    ]) == [["A]x", "B[y"], ["B"], ["B", "C", "D"], ["E"]]
