import ipaddress
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from openings.functions.identity import identity_url, public_url
from openings.operators import registry

NAMES = [
    ("Acme Inc", "Acme"), ("Acme", "__REDIRECT__other"), ("Acme", None), ("The Group", "Jobs"), ("Exponent Partners", "Exponent"), ("Par", "Parachute Health"), ("Globex Energy", "Globex Energie"), ("Initech", "Initrode"),
    ("Umbrella Systems", "Umbrella System"), ("Alpha Beta Gamma Delta", "Alpha Beta Gamma"), ("Stark", "Wayne"), ("Blue Ocean", "Ocean Blue"),
]


def plain_verdict(asked, declared):
    tokens = lambda s: [w for w in re.sub(r"[^\w\s&]", " ", (s or "").lower()).split() if w not in registry.NAME_NOISE]
    if declared and declared.startswith("__REDIRECT__"):
        return "bad"
    a, d = tokens(asked), tokens(declared)
    if not declared or not a or not d:
        return "review"
    x, y = "".join(a), "".join(d)
    if x == y:
        return "ok"
    if a[0] != d[0] and a[0] not in d and d[0] not in a:
        return "bad"
    if len(a) >= 2 and d == [a[0]]:
        return "review"
    short, long = sorted((x, y), key=len)
    if short in long and len(short) / len(long) >= 0.6:
        return "ok"
    return "ok" if SequenceMatcher(None, x, y).ratio() >= 0.85 or len({*a} & {*d}) / len({*a} | {*d}) >= 0.75 else "review"


def test_compared_names(spark):
    got = registry.compare_names(spark.createDataFrame(NAMES, "asked string, declared string")).collect()
    assert {(x.asked, x.declared): x.verdict for x in got} == {n: plain_verdict(*n) for n in NAMES}


def test_public_urls(spark):
    cases = {
        "https://example.com": "https://example.com", "HTTP://EXAMPLE.com:80/a b": "", "https://example.com/(x)": "https://example.com/%28x%29", "https://10.0.0.1/": "", "https://8.8.8.8/": "https://8.8.8.8/", "https://2130706433/": "", "https://0x7f.1/": "",
        "https://a:b@example.com/": "", "https://x.localhost/": "", "//example.com": "", "https://example.com\\@evil": "", "": "", "https://exa​mple.com/": "",
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "u string")
    got = {x.u: x.v for x in df.select("u", public_url(F.col("u")).alias("v")).collect()}
    assert got == cases | {None: ""}


def test_hosts_outside_ascii_and_addresses(spark):
    """Names by Python's own codec, addresses by its ipaddress: spelling and public ranges."""
    rng = random.Random(4)
    groups = ["0", "0", "0", "1", "db8", "2001", "2002", "2606", "ffff", "fe80", "fc00", "ff02", "64", "ff9b", "20", "30", "4", "112", "3", "2a00"]
    addresses = [ipaddress.IPv6Address(":".join(rng.choice(groups) for _ in range(8))) for _ in range(400)]
    addresses += [ipaddress.IPv6Address(a) for a in ("::", "::1", "2001:db8::", "1::", "2001:1::1", "2001:1::2", "2001:4:112::5", "2001:20::1", "2001:3::1", "3fff:fff::1", "3fff:1000::1", "2606:4700::1111", "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4")]
    spelled = {f"https://[{rng.choice([a.exploded, a.exploded.upper(), a.compressed])}]/x": a for a in addresses}
    names = ["bücher.de", "BÜCHER.de", "faß.de", "例え。テスト", "a.b.例え", "☃.net", "münchen.example.com.", "ﬃx.com"]
    mapped = {f"https://[::ffff:{v}]/": v for v in ("8.8.8.8", "127.0.0.1", "10.1.2.3", "192.0.0.9")}
    bad = ["https://a..ü/x#f", "https://" + "ü" * 70 + ".de/", "https://[zz]/", "https://[1.2.3.4]/", "https://[::1/", "https://℀.com/", "https://x.com:70000/#f", "https://[fe80::1::2]/"]
    urls = [*spelled, *[f"https://{n}/x" for n in names], *mapped, *bad, "HTTPS://u:p@EXAMPLE.com:0443#f", "https://[fe80::1%25eth0]:80/", "https://x.com:/a?", "https://127。0。0。1/", "https://x.com/ä(b)?q=é&[1]#ü#", None]
    got = {r.u: (r.i, r.p) for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", identity_url(F.col("u")).alias("i"), public_url(F.col("u")).alias("p")).collect()}

    def open_(a):  # 3fff::/20 is documentation since 2024, which older Pythons don't know
        return not str(a).startswith("3fff:fff:") and a.is_global and not (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified)

    for url, a in spelled.items():
        if a.ipv4_mapped is None:
            assert got[url] == (f"https://[{a.compressed}]/x", f"https://[{a.compressed}]/x" if open_(a) else ""), url
    for name in names:
        made = f"https://{name.lower().rstrip('.').encode('idna').decode()}/x"
        assert got[f"https://{name}/x"] == (made, made)
    for url, v4 in mapped.items():
        assert got[url] == (url, url if open_(ipaddress.ip_address(v4)) else "")
    for url in bad:
        assert got[url] == (url.split("#")[0], "")
    assert got["HTTPS://u:p@EXAMPLE.com:0443#f"] == ("https://example.com/", "")
    assert got["https://[fe80::1%25eth0]:80/"] == ("https://[fe80::1]:80/", "")
    assert got["https://x.com:/a?"] == ("https://x.com/a", "https://x.com/a")
    assert got["https://127。0。0。1/"] == ("https://127.0.0.1/", "")
    assert got["https://x.com/ä(b)?q=é&[1]#ü#"][1] == "https://x.com/%C3%A4%28b%29?q=%C3%A9&%5B1%5D#%C3%BC%23"
    assert got[None] == ("", "")
