"""Address functions on columns: normalising, resolving, comparing, judging.

Everything is a composition of built-in functions, so it stays inside the JVM. Only hosts
with non-ASCII letters need a lookup Spark has no function for (IDNA); `normalize_urls`
sends just the distinct hosts of that kind through an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscore import fixed_values as fv



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once.

    A column used several times inside one expression is repeated in the plan each time, and
    nested repeats grow without bound. A lambda variable over a one-element array holds the
    value instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _alternatives(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


# --- parts -----------------------------------------------------------------------------------


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def origin(url: Column) -> Column:
    """Scheme, host and port."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host_in(authority: Column) -> Column:
    """Lower-case host of a host:port part, '' when there is none."""
    host = F.regexp_extract(authority, r"^(?:[^@]*@)*(?:\[([^\]]*)\]|([^:@\[]*))", 2)
    address = F.regexp_extract(authority, r"^(?:[^@]*@)*\[([^\]]*)\]", 1)
    return F.lower(F.concat(address, host))


def domain(url: Column) -> Column:
    """Lower-case host name, '' when there is none."""
    return F.coalesce(let(authority_of(url), host_in), F.lit(""))


def site_domain(host: Column) -> Column:
    """The registrable name: two labels, or three under country second-level labels."""
    second = "|".join(fv.SECOND_LEVEL_LABELS)
    return let(
        F.regexp_replace(F.lower(host), r"^\.+|\.+$", ""),
        lambda name: F.coalesce(
            F.nullif(F.regexp_extract(
                name, rf"(?:^|\.)([^.]*\.(?:{second})\.[^.]{{2}})$", 1), F.lit("")),
            F.nullif(F.regexp_extract(name, r"(?:^|\.)([^.]*\.[^.]*)$", 1), F.lit("")),
            name,
        ),
    )


def same_site(host: Column, other: Column) -> Column:
    return site_domain(host) == site_domain(other)


def site_root(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/"))


def same_origin(a: Column, b: Column) -> Column:
    return origin(a) == origin(b)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path_of(url)), "/"), lambda part: part != "")


def url_host(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(domain(url), r"^www\.", "")


def url_path(url: Column) -> Column:
    """Path and query, '/' when both are empty."""
    query = query_of(url)
    text = F.concat(path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(text == "", "/").otherwise(text)


def is_page_address(url: Column) -> Column:
    """False for addresses whose ending shows a file, not a web page."""
    before_query = F.element_at(F.split(url, r"\?", 2), 1)
    return ~before_query.rlike(rf"(?i)\.({_alternatives(fv.NON_PAGE_EXTENSIONS)})$")


def file_stem(src: Column) -> Column:
    name = F.element_at(F.split(path_of(src), "/"), -1)
    return F.regexp_replace(name, fv.IMAGE_FILE, "")


# --- normalising -----------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def to_idna(hosts: pd.Series) -> pd.Series:
    """Punycode of international host names; null where the name is not allowed."""

    def encode(host: str | None) -> str | None:
        try:
            return host.encode("idna").decode("ascii") if host is not None else None
        except UnicodeError:
            return None

    return hosts.map(encode)


def _with_scheme(raw: Column) -> Column:
    tidy = F.regexp_replace(raw, r"^[\s\x00-\x20]+|\s+$|[\t\r\n]", "")
    return let(tidy, lambda text: F.when(text.contains("://"), text).otherwise(
        F.concat(F.lit("https://"), text)))


def _host_port(text: Column) -> Column:
    return F.regexp_replace(authority_of(text), "^.*@", "")


def typed_host(raw: Column) -> Column:
    """The host inside what somebody typed, before any IDNA encoding."""
    host = F.regexp_extract(_host_port(_with_scheme(raw)), r"^(\[[^\]]*\]|[^:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def normalize_url(raw: Column, idna_host: Column | None = None) -> Column:
    """One canonical http(s) address, or null.

    Hosts with non-ASCII letters come out null unless `idna_host` holds their encoding.
    """
    def parts(text: Column) -> Column:
        typed = F.regexp_replace(
            F.lower(F.regexp_extract(_host_port(text), r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.+$", "")
        return F.struct(
            scheme_of(text).alias("scheme"),
            (typed if idna_host is None else F.coalesce(idna_host, typed)).alias("host"),
            F.regexp_extract(_host_port(text), r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1).alias("port"),
            path_of(text).alias("path"), query_of(text).alias("query"),
        )

    def assemble(p: Column) -> Column:
        port = p["port"]
        number = port.try_cast("int")
        default = ((p["scheme"] == "http") & (number == 80)) | (
            (p["scheme"] == "https") & (number == 443))
        shown_port = F.when((port == "") | default, "").otherwise(
            F.concat(F.lit(":"), number.cast("string")))
        port_ok = (port == "") | (port.rlike(r"^\d{1,5}$") & (number <= 65535))
        named = ~p["host"].rlike(r"(^|\.)(\.|$)|[^.]{64,}")
        host_ok = ~p["host"].rlike(r"[^\x00-\x7f]") & (p["host"].startswith("[") | named)
        clean = F.concat(
            p["scheme"], F.lit("://"), p["host"], shown_port,
            F.when(p["path"] == "", "/").otherwise(p["path"]),
            F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])),
        )
        usable = p["scheme"].isin("http", "https") & (p["host"] != "") & host_ok & port_ok
        return F.when(usable, clean)

    return F.when(
        F.trim(raw) != "", let(let(_with_scheme(raw), parts), assemble))


def normalize_urls(df: DataFrame, column: str, output: str = "normalized") -> DataFrame:
    """`normalize_url` for a whole table, international hosts included.

    Only the distinct non-ASCII hosts visit Python; their encodings come back by an equi
    join on the host. Rows with ASCII hosts carry a null key and are never matched, so they
    are not sorted onto one join task.
    """
    host = typed_host(F.col(column))
    wide = df.withColumn("__host", F.when(host.rlike(r"[^\x00-\x7f]"), host))
    encoded = (
        wide.where("__host is not null")
        .groupBy("__host").count()
        .select("__host", to_idna("__host").alias("__idna"))
    )
    joined = wide.join(encoded, "__host", "left")
    return joined.withColumn(
        output, normalize_url(F.col(column), F.col("__idna"))
    ).drop("__host", "__idna")


# --- resolving -------------------------------------------------------------------------------


def _resolve_dots(path: Column) -> Column:
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    joined = F.array_join(kept, "/")
    ended = F.when(path.rlike(r"(^|/)\.{1,2}$"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return let(ended, lambda text: F.when(text.startswith("/"), text).otherwise(
        F.concat(F.lit("/"), text)))


def join_url(base: Column, href: Column) -> Column:
    """A reference resolved against the page it stands on."""
    def relative(r: Column) -> Column:
        path, query = r["path"], r["query"]
        base_path = r["base_path"]
        folder = F.regexp_replace(base_path, "[^/]*$", "")
        whole = (
            F.when(path == "", base_path)
            .when(path.startswith("/"), path)
            .otherwise(F.concat(folder, F.regexp_replace(path, "/{2,}", "/")))
        )
        resolved = let(whole, lambda p: F.when(
            p.rlike(r"(^|/)\.{1,2}(/|$)"), _resolve_dots(p)).otherwise(p))
        kept = F.when((path == "") & ~href.contains("?"), query_of(base)).otherwise(query)
        return F.concat(
            origin(base), resolved,
            let(kept, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))),
            F.regexp_extract(href, "(#.*)$", 1))

    pieces = F.struct(
        path_of(href).alias("path"), query_of(href).alias("query"),
        let(path_of(base), lambda p: F.when(p == "", "/").otherwise(p)).alias("base_path"))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme_of(base), F.lit(":"), href))
        .otherwise(let(pieces, relative))
    )


def absolute(base: Column, href: Column) -> Column:
    """The web address a link leads to; null for anchors and non-web schemes."""
    def web(joined: Column) -> Column:
        return F.when(scheme_of(joined).isin("http", "https"), normalize_url(joined))

    def resolve(text: Column) -> Column:
        skip = (text == "") | text.rlike("^(#|mailto:|tel:|javascript:|data:)")
        return F.when(~skip, let(join_url(base, text), web))

    return let(F.regexp_replace(href, r"^\s+|\s+$", ""), resolve)


# --- judging ---------------------------------------------------------------------------------


def _query_pairs(url: Column) -> Column:
    return F.filter(F.split(query_of(url), "&"), lambda pair: pair != "")


def _unquote(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def query_keys(url: Column) -> Column:
    return F.transform(
        _query_pairs(url), lambda pair: F.lower(_unquote(F.element_at(F.split(pair, "=", 2), 1)))
    )


def url_problems(url: Column, https_site: Column) -> Column:
    """Names of the rules an address breaks, in a fixed order."""
    path = path_of(url)
    keys = query_keys(url)
    return F.array_compact(
        F.array(
            F.when(path.rlike(r"\p{Lu}"), fv.URL_PROBLEMS["upper"]),
            F.when(path.contains("_"), fv.URL_PROBLEMS["underscore"]),
            F.when(path.contains("%20") | path.contains(" ") | path.contains("+"), fv.URL_PROBLEMS["space"]),
            F.when(path.contains("//"), fv.URL_PROBLEMS["slash"]),
            F.when(
                F.exists(keys, lambda key: key.isin(fv.SESSION_PARAMS)),
                fv.URL_PROBLEMS["session"],
            ),
            F.when(
                https_site & (scheme_of(url) == "http"), fv.URL_PROBLEMS["insecure"]
            ),
        )
    )


def url_notes(url: Column) -> Column:
    """Milder remarks about an address, in a fixed order."""
    path = path_of(url)
    tracked = "^(" + _alternatives(fv.TRACKING_PREFIXES) + ")"
    ending = F.regexp_extract(F.lower(path), rf"\.({_alternatives(fv.OLD_EXTENSIONS)})$", 1)
    return F.array_compact(
        F.array(
            F.when(F.length(url) > fv.URL_MAX, f"longer than {fv.URL_MAX} characters"),
            F.when(
                F.size(F.filter(F.split(path, "/"), lambda part: part != "")) > fv.DEPTH_MAX,
                f"more than {fv.DEPTH_MAX} folders deep",
            ),
            F.when(
                F.size(F.filter(query_keys(url), lambda key: ~key.rlike(tracked))) > 2,
                "many ? parameters",
            ),
            F.when(ending != "", F.concat(F.lit("technical ending ("), ending, F.lit(")"))),
        )
    )


def _quote_plus(text: Column) -> Column:
    encoded = F.url_encode(_unquote(text))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_url(url: Column) -> Column:
    """The same address in the usual style: lower case, hyphens, no session ids, https."""
    path = F.regexp_replace(F.lower(path_of(url)), r"%20|\+| |_+", "-")
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "-{2,}", "-")
    kept = F.filter(
        _query_pairs(url),
        lambda pair: ~F.lower(_unquote(F.element_at(F.split(pair, "=", 2), 1))).isin(
            fv.SESSION_PARAMS
        ),
    )
    query = F.array_join(
        F.transform(
            kept,
            lambda pair: F.concat(
                _quote_plus(F.element_at(F.split(pair, "=", 2), 1)), F.lit("="),
                _quote_plus(F.coalesce(F.try_element_at(F.split(pair, "=", 2), F.lit(2)),
                                       F.lit(""))),
            ),
        ),
        "&",
    )
    return F.concat(
        F.lit("https://"), authority_of(url),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
