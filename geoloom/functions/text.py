"""URLs, HTML attributes and embedded JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the host that article addresses are relative to.
HOST = "https://mp.weixin.qq.com"


def absolute_url(url: Column, host: str = HOST) -> Column:
    """Protocol-relative, root-relative, absolute and bare addresses on a host; blank stays blank."""
    u = F.trim(url)
    return F.when(u == "", "").when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(F.lit(host), u)).when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit(host + "/"), F.ltrim(u, F.lit("/"))))


def without_dots(path: Column) -> Column:
    """A path that starts with a slash without its . and .. parts."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), empty, lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))))
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def joined_url(base: Column, url: Column) -> Column:
    """url against the page it is on: absolute, protocol-relative, root-relative, a query or fragment, or relative to the page's folder; . and .. are resolved."""
    scheme, root = F.regexp_extract(base, r"^(https?:)", 1), F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^https?://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(page, "^$", "/"), r"^(.*/)[^/]*$", 1)
    path, rest = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    local = F.concat(root, without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), rest)
    query = F.concat(root, page, F.when(url.startswith("#"), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)).otherwise(""), url)
    return F.when(url == "", F.regexp_replace(base, "#.*$", "")).when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(scheme, url)).when(path == "", query).otherwise(local)


def image_extension(url: Column) -> Column:
    """Extension of an address's path if it is an image's; .jpg else."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    ext = F.regexp_extract(path, r"\.(jpg|jpeg|png|gif|webp|bmp)$", 0)
    return F.when(ext == "", ".jpg").otherwise(ext)


def download_name(prefix: str, index: Column, url: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.lpad(index.cast("string"), 4, "0"), image_extension(url))


def tag_attributes(html: Column, tag: str, attribute: str) -> Column:
    """All values of an attribute of a tag, in order, quotes of either kind."""
    found = F.regexp_extract_all(html, F.lit(rf"""(?is)<{tag}\b[^>]*?\s{attribute}\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.filter(found, lambda v: v != "")


def page_images(html: Column) -> Column:
    """Distinct image addresses, sorted: preview metas, and each img's data-src, else data-original, else src."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))

    def of(t: Column, a: str) -> Column:
        return F.nullif(F.regexp_extract(t, rf"""(?is)\s{a}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))

    body = F.transform(tags, lambda t: F.coalesce(of(t, "data-src"), of(t, "data-original"), of(t, "src")))
    metas = [F.regexp_extract_all(html, F.lit(rf"""(?is)<meta\b[^>]*(?:property|name)\s*=\s*["']{k}["'][^>]*content\s*=\s*["']([^"']*)["']"""), F.lit(1)) for k in ("og:image", "twitter:image")]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*metas, body), lambda v: v.isNotNull() & (v != ""))))


def unescape_html(text: Column) -> Column:
    """The entities that JSON in a page is written with; the ampersand last."""
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def unescape_string(text: Column) -> Column:
    """Escapes of a script's string literal (quotes, line ends, \\uXXXX); a text that is no such literal stays as it is."""
    return F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "v string")["v"], text)


def embedded_json(html: Column, patterns: list[str], escaped: bool = False) -> Column:
    """First group of the first pattern that is found (dot matches newlines), unescaped (also as a script's string if asked); null if none is."""
    found = unescape_html(F.coalesce(*[F.nullif(F.regexp_extract(html, "(?s)" + p, 1), F.lit("")) for p in patterns]))
    return unescape_string(found) if escaped else found


# Fixed value: the shape of a message list.
ARTICLES = "list array<struct<app_msg_ext_info:struct<title:string,content_url:string,cover:string,multi_app_msg_item_list:array<struct<title:string,content_url:string,cover:string>>>>>"


def articles(json: Column) -> Column:
    """Array of (title, content_url, cover) of a message list; sub-items without a cover take their parent's."""
    rows = F.filter(F.from_json(json, ARTICLES)["list"], lambda m: m["app_msg_ext_info"].isNotNull())

    def both(m: Column) -> Column:
        i = m["app_msg_ext_info"]
        head = F.struct(i["title"].alias("title"), i["content_url"].alias("content_url"), i["cover"].alias("cover"))
        rest = F.transform(F.coalesce(i["multi_app_msg_item_list"], F.array().cast("array<struct<title:string,content_url:string,cover:string>>")), lambda s: F.struct(s["title"].alias("title"), s["content_url"].alias("content_url"), F.coalesce(F.nullif(s["cover"], F.lit("")), i["cover"]).alias("cover")))
        return F.concat(F.array(head), rest)

    return F.flatten(F.transform(rows, both))


def inverse_map(m: Column) -> Column:
    """A map from values to keys; values must be distinct."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))
