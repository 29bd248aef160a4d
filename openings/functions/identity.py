"""Identity of postings, urls and boards."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import company_key, title_key

# Sources that are an employer's own platform.
ATS_SOURCES = (
    "greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee", "bamboohr", "rippling", "teamtailor", "workday", "oracle_orc",
    "eightfold", "phenom", "icims", "jobvite", "paylocity", "personio", "hrmdirect", "pinpoint", "neogov",
)


def base_source(source: Column) -> Column:
    """The namespace of a source: what stands before its first colon, lower-cased."""
    return F.lower(F.substring_index(F.coalesce(source, F.lit("")), ":", 1))


def is_ats(source: Column) -> Column:
    return F.lower(F.trim(F.coalesce(source, F.lit("")))).isin(*ATS_SOURCES)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 20)


#: scheme, user info, host (a name, or an address in brackets), port, path, query.
_URL = r"^(?i:(https?))://([^/?#]*@)?(\[[^/?#@\[\]]*\]|[^/?#@:\[\]]*)(?::(\d*))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: calls into the JVM are never recognised as common subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _address(bracketed: Column) -> Column:
    """An IPv6 literal in brackets as eight groups (a.b.c.d if it maps IPv4), null if it isn't one; a zone is left out."""
    inside = F.lower(F.regexp_extract(bracketed, r"^\[([^\]%]*)(?:%[^\]]*)?\]$", 1))
    # only what can be a literal: in brackets the JVM parses it or fails, and never looks a name up
    literal = F.when(inside.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$"), F.concat(F.lit("["), inside, F.lit("]")))
    return F.when(literal.isNotNull(), F.substring_index(F.try_reflect(F.lit("java.net.InetAddress"), F.lit("getByName"), literal), "/", -1))


def _shown_address(groups: Column) -> Column:
    """The shortest spelling of _address: the first of its longest runs of zero groups (two or more) becomes ::."""
    shown = groups
    for n in range(2, 9):  # the longest run decides, so it is the outermost case
        run = rf"^(|.*?:)0(?::0){{{n - 1}}}(?:$|:(.*))$"
        shown = F.when(groups.rlike(run), F.concat(F.regexp_replace(F.regexp_extract(groups, run, 1), ":$", ""), F.lit("::"), F.regexp_extract(groups, run, 2))).otherwise(shown)
    return F.when(groups.contains("."), F.concat(F.lit("::ffff:"), groups)).otherwise(shown)


def ascii_host(host: Column) -> Column:
    """A host as it is compared, null if it is none: lower case, no dots at its end, names outside ASCII in their xn-- form, IPv6 literals in their shortest spelling.

    Names outside ASCII go through the JVM's own IDN, and only they; nothing leaves the JVM.
    """
    name = F.regexp_replace(F.lower(host), r"\.+$", "")
    coded = F.when(name.rlike(r"[^\x00-\x7F]"), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name, F.lit(1)))).otherwise(name)
    # characters whose compatibility form holds a delimiter must not open another part of the url
    fits = r"^[^./?#@:\[\]]{1,63}(\.[^./?#@:\[\]]{1,63})*$"
    return F.when(host.startswith("["), F.concat(F.lit("["), _let(_address(host), _shown_address), F.lit("]"))).otherwise(_let(coded, lambda c: F.when(c.rlike(fits), c)))


def _port(digits: Column) -> Column:
    """A port as a number, -1 if it is none, null if there is none."""
    return F.when(digits != "", F.when(F.coalesce(digits.try_cast("bigint"), F.lit(-1)) <= 65535, F.coalesce(digits.try_cast("bigint"), F.lit(-1))).otherwise(-1))


def identity_url(url: Column) -> Column:
    """A url for comparison: lower-cased scheme, host as in ascii_host, no user info, no default port, no fragment, / for an empty path.

    What isn't http or https, or has no such host or port, just loses the
    fragment; null is "".
    """
    raw = F.trim(F.coalesce(url, F.lit("")))
    bare = F.substring_index(raw, "#", 1)
    scheme, host, digits, path, query = (F.regexp_extract(raw, _URL, i) for i in (1, 3, 4, 5, 6))
    scheme, port = F.lower(scheme), _port(digits)
    shown = F.when(port != F.when(scheme == "https", 443).otherwise(80), F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    whole = F.concat(scheme, F.lit("://"), ascii_host(host), shown, F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    return F.coalesce(F.when(raw.rlike(_URL) & (F.coalesce(port, F.lit(0)) >= 0), whole), bare)  # null without a host


def discriminator(source: Column, locator: Column) -> Column:
    """A token for (source, locator) that no other pair shares: both are prefixed with their lengths."""
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    x = F.coalesce(locator, F.lit(""))
    return short_hash(F.concat(F.length(s).cast("string"), F.lit(":"), s, F.lit("|"), F.length(x).cast("string"), F.lit(":"), x))


def _basis(company: Column, title: Column, source: Column, url: Column, external_id: Column) -> Column:
    key = company_key(company)
    url_ = identity_url(url)
    blank = discriminator(source, F.when(url_ != "", url_).otherwise(F.trim(F.coalesce(external_id, F.lit("")))))
    return F.concat(key, F.lit("|"), title, F.when((key == "") & ~is_ats(source), F.concat(F.lit("|anonymous:"), blank)).otherwise(""))


def group_key(company: Column, title: Column, source: Column, url: Column, external_id: Column) -> Column:
    """Company and loose title: sightings of one role."""
    return short_hash(_basis(company, title_key(title), source, url, external_id))


def opening_uid(company: Column, title: Column, source: Column, url: Column, external_id: Column) -> Column:
    """One opening: company, strict title, and the requisition (platforms) or the feed's own locator (named aggregator rows)."""
    basis = _basis(company, title_key(title, strict=True), source, url, external_id)
    own = F.trim(F.coalesce(external_id, F.lit("")))
    feed = discriminator(source, F.when(own != "", own).otherwise(identity_url(url)))
    more = (
        F.when(is_ats(source) & (F.coalesce(external_id, F.lit("")) != ""), F.concat(F.lit("|"), external_id))
        .when(~is_ats(source) & (company_key(company) != ""), F.concat(F.lit("|aggregator:"), feed))
        .otherwise("")
    )
    return short_hash(F.concat(basis, more))


def cross_source_key(company: Column, source: Column, url: Column) -> Column:
    """What proves a native and a discovered sighting to be one opening: platform, company and exact url; null where either isn't known."""
    platform = F.when(F.lower(source).startswith("freehire:"), F.substring_index(F.lower(source), ":", -1)).otherwise(base_source(source))
    platform = F.when(platform == "oracle", "oracle_orc").otherwise(platform)
    usable = (company_key(company) != "") & platform.isin(*ATS_SOURCES) & (identity_url(url) != "")
    return F.when(usable, F.concat_ws("|", platform, company_key(company), identity_url(url)))


def board_id(ats: Column, slug: Column, tenant: Column, site: Column, host: Column) -> Column:
    """A board's stable id: platform and its address."""
    address = (
        F.when(ats == "workday", F.concat_ws("/", tenant, site))
        .when(ats.isin("oracle_orc", "phenom", "eightfold", "icims"), F.concat_ws("/", host, site))
        .otherwise(slug)
    )
    return F.lower(F.concat(ats, F.lit(":"), F.coalesce(address, F.lit(""))))


def url_platform(url: Column) -> Column:
    """(platform, address) that a url's host and path name; null elsewhere.  Query strings never count."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    first = F.regexp_extract(path, r"^/([^/]+)", 1)
    hit = lambda name, test, address: F.when(test & (address != ""), F.struct(F.lit(name).alias("platform"), address.alias("address")))
    under = lambda suffix: host.endswith("." + suffix) | (host == suffix)
    label = F.regexp_extract(host, r"^([a-z0-9-]+)\.", 1)
    return F.coalesce(
        hit("greenhouse", host.isin("boards.greenhouse.io", "job-boards.greenhouse.io"), first),
        hit("lever", host.isin("jobs.lever.co", "jobs.eu.lever.co"), first),
        hit("ashby", host == "jobs.ashbyhq.com", first),
        hit("smartrecruiters", host.isin("jobs.smartrecruiters.com", "careers.smartrecruiters.com"), first),
        hit("workable", host == "apply.workable.com", first),
        hit("recruitee", under("recruitee.com"), label),
        hit("bamboohr", under("bamboohr.com"), label),
        hit("teamtailor", under("teamtailor.com"), label),
        hit("workday", under("myworkdayjobs.com"), F.concat_ws("/", label, F.regexp_extract(path, r"^/(?:[a-z]{2}-[A-Z]{2}/)?([^/]+)", 1))),
        hit("personio", under("jobs.personio.de") | under("jobs.personio.com"), label),
        hit("pinpoint", under("pinpointhq.com"), label),
    )


def site_operand(url: Column, operand: str) -> Column:
    """Whether `site:operand` covers the url: host or subdomain, and path prefix at a segment boundary."""
    host_part, _, path_part = operand.lower().partition("/")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    on_host = (host == host_part) | host.endswith("." + host_part)
    if not path_part:
        return on_host
    prefix = "/" + path_part.strip("/")
    return on_host & ((path == prefix) | path.startswith(prefix + "/"))


# Host names that never are public.
LOCAL_HOSTS = ("localhost", "local", "internal", "lan", "home", "home.arpa", "intranet", "corp", "private")
#: A char that no link may hold as it is: blanks, controls, format characters, back-slashes.
_UNSAFE = r"[\x00-\x20\x7F\\\\\p{Cf}]"
# IPv4 ranges that aren't public, but for two addresses of 192.0.0.0/24.
_CLOSED_IPV4 = r"^(0|10|127|22[4-9]|23\d|24\d|25[0-5])\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^192\.0\.2\.|^192\.0\.0\.(?!(9|10)$)|^198\.(1[89]|51\.100)\.|^203\.0\.113\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\."


def _public_ipv6(groups: Column) -> Column:
    """Whether eight groups are a public address: within 2000::/3, without documentation, 6to4 and the protocol block 2001::/23 but for its public parts."""
    group = lambda i: F.conv(F.split(groups, ":")[i], 16, 10).cast("int")
    first, second = group(0), group(1)
    tail = F.regexp_replace(groups, r"^[^:]*:", "")
    protocol = (first == 0x2001) & (second < 0x200)
    opened = tail.rlike(r"^1(:0){5}:[12]$|^3:|^4:112:|^[23][0-9a-f]:")
    return first.between(0x2000, 0x3FFF) & (~protocol | opened) & ~((first == 0x2001) & (second == 0xDB8)) & (first != 0x2002) & ~((first == 0x3FFF) & (second < 0x1000))


def _encoded(part: Column, safe: str) -> Column:
    """part with every character outside `safe` percent-encoded in UTF-8."""
    runs = F.regexp_extract_all(part, F.lit(rf"(?s)[{safe}]+|[^{safe}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(rf"^[{safe}]"), r).otherwise(F.regexp_replace(F.hex(F.encode(r, "UTF-8")), "(..)", "%$1"))), "")


def public_url(url: Column, limit: int = 2048) -> Column:
    """The url if it may be shown as a link, else "".

    http or https, no credentials, no blanks or hidden characters, at most
    `limit` long; a host of two labels or more that isn't local (names outside
    ASCII are shown in their xn-- form), or an IPv4 or IPv6 literal of the
    public ranges in its shortest spelling; IPv4 in an IPv6 literal counts as
    itself.  Other spellings of addresses aren't shown.  What isn't safe behind
    the host is percent-encoded.
    """
    raw = F.coalesce(url, F.lit(""))
    scheme, user, host, digits, path, query = (F.regexp_extract(raw, _URL, i) for i in range(1, 7))
    fragment = F.regexp_extract(raw, r"(?s)^[^#]*#(.*)$", 1)
    port = _port(digits)
    label = r"[a-z0-9]([a-z0-9-]*[a-z0-9])?"

    def public(groups: Column, host: Column) -> Column:
        named = host.rlike(rf"^{label}(\.{label})+$") & (F.length(host) <= 253) & ~host.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+))*$")
        local = host.rlike(r"(^|\.)(" + "|".join(re.escape(n) for n in LOCAL_HOSTS) + ")$")
        v4 = F.when(host.startswith("["), F.when(groups.contains("."), groups)).otherwise(host)
        return F.when(v4.rlike(_DOTTED), ~v4.rlike(_CLOSED_IPV4)).when(host.startswith("["), _public_ipv6(groups)).otherwise(named & ~local)

    shown = _let(F.struct(_address(host).alias("groups"), ascii_host(host).alias("host")), lambda h: F.when(public(h["groups"], h["host"]), h["host"]))
    fine = raw.rlike(_URL) & (user == "") & ~raw.rlike(_UNSAFE) & (F.length(raw) <= limit) & (F.coalesce(port, F.lit(0)) >= 0)
    safe = r"A-Za-z0-9_.~/%:@!$&'+,;=\-"
    rest = F.concat(_encoded(path, safe), *[F.when(part != "", F.concat(F.lit(mark), _encoded(part, safe + "?"))).otherwise("") for mark, part in (("?", F.regexp_replace(query, r"^\?", "")), ("#", fragment))])
    whole = F.concat(F.lower(scheme), F.lit("://"), shown, F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")), rest)
    return F.coalesce(F.when(fine, whole), F.lit(""))  # null without a public host
