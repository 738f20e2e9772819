import hashlib
import ipaddress
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfspark.functions import scalars, web


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, rows, kind, make):
    return [r.y for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(make(F.col("x")).alias("y")).collect()]


def test_hash_split_is_sha1_modulo_ten(spark):
    keys = [f"key{i}" for i in range(300)]
    want = [scalars.BUCKETS[int(hashlib.sha1(k.encode()).hexdigest(), 16) % 10] for k in keys]
    assert values(spark, keys, "string", scalars.hash_split) == want
    assert 0.7 < want.count("train") / 300 < 0.9


def test_title_hash(spark):
    want = int.from_bytes(hashlib.sha1(b"blue widget").digest()[:8], "big") >> 1
    assert values(spark, ["Blue  Widget", " blue\twidget\n", "", None, "blue widgets"], "string", scalars.title_hash)[:4] == [want, want, 0, 0]


def test_tokens(spark):
    assert values(spark, ["A-b, c2 é!", "", None], "string", scalars.tokens) == [["a", "b", "c2", "é"], [], []]


def test_localized_pick(spark):
    entries = [[("de_DE", "x"), ("en_GB", "b"), ("en_US", ""), ("en_US", "a"), ("en_US", "later")], [("en_GB", "b")], [("de_DE", "x")], [], None]
    rows = spark.createDataFrame([(e,) for e in entries], "e array<struct<language_tag:string,value:string>>")
    got = rows.select(scalars.localized_pick(F.col("e")).alias("p")).collect()
    assert [(r.p.value, r.p.tag) for r in got] == [("a", "en_US"), ("b", "en_GB"), (None, None), (None, None), (None, None)]


def test_plausible_photo(spark):
    rows = spark.createDataFrame([(400, 100), (401, 100), (100, 400), (100, 0), (None, 5)], "w int, h int")
    assert [r.x for r in rows.select(scalars.plausible_photo(F.col("w"), F.col("h")).alias("x")).collect()] == [True, False, True, False, False]


def test_hamming_and_tiles(spark):
    assert one(spark, scalars.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64
    a, b = (F.array(*map(F.lit, x)) for x in ([0, 0, 0], [0, 1, 7]))
    assert one(spark, scalars.tiles_agreeing(a, b, 1)) == 2
    with pytest.raises(PySparkException):
        one(spark, scalars.tiles_agreeing(a, F.array(F.lit(1)), 1))
    assert one(spark, scalars.hex16(F.lit(255).cast("long"))) == "00000000000000ff"


def test_rank_metrics(spark):
    assert values(spark, [1, 10, 11], "int", lambda r: scalars.recall_at(r, 10)) == [1.0, 1.0, 0.0]
    assert values(spark, [1, 3, 11], "int", scalars.ndcg_at) == pytest.approx([1.0, 0.5, 0.0])
    assert values(spark, [1, 4], "int", scalars.reciprocal_rank) == [1.0, 0.25]
    assert one(spark, scalars.claimed(F.lit(-2.0), F.lit(-1.0))) and not one(spark, scalars.claimed(F.lit(-1.0), F.lit(0.0)))


def test_learning_rate(spark):
    got = values(spark, [0, 9, 10, 60, 110, 500], "int", lambda s: scalars.learning_rate(s, 1.0, 10, 110))
    assert got == pytest.approx([0.1, 1.0, 1.0, 0.5, 0.0, 0.0], abs=1e-12)
    assert values(spark, [3, 20], "int", lambda s: scalars.learning_rate(s, 2.0, 10, 10)) == pytest.approx([0.8, 2.0])
    assert math.isclose(one(spark, scalars.round4(F.lit(0.00005))), 0.0001, abs_tol=1e-4)


def test_colour_name(spark):
    rows = spark.createDataFrame([(240, 240, 240), (200, 200, 200), (100, 100, 100), (0, 0, 0), (250, 200, 190), (90, 10, 10), (10, 90, 10), (10, 10, 90)], "r int, g int, b int")
    got = [r.x for r in rows.select(scalars.colour_name(*map(F.col, "rgb")).alias("x")).collect()]
    assert got == ["off-white", "light grey", "grey", "dark grey or black", "a light reddish or warm colour", "a reddish or warm colour", "a greenish colour", "a bluish colour"]


def test_url_gate(spark):
    host = web.IMAGE_HOSTS[0]
    urls = [f"https://{host}/a.jpg", f"http://{host}/a.jpg", f"https://{host}.evil.com/a", f"https://x@{host}:443/a", f"https://{host}:8443/a", "https:///a", "file:///etc/passwd", None, f"https://{host.upper()}/a"]
    assert values(spark, urls, "string", web.url_gate) == [None, "scheme", "host", None, "port", "no host", "scheme", "scheme", None]


def test_variant_and_product_id(spark):
    urls = ["https://m.media-amazon.com/images/I/51abc._AC_SS115_.jpg", "https://m.media-amazon.com/images/I/51abc.jpg", "https://x/y.png"]
    assert values(spark, urls, "string", web.variant_strip) == ["https://m.media-amazon.com/images/I/51abc.jpg"] * 2 + ["https://x/y.png"]
    texts = ["B08XPWDSWW", " B08XPWDSWW ", "https://www.amazon.com/x/dp/B08XPWDSWW/r", "/gp/product/B08XPWDSWW", "/ASIN/B08XPWDSWW", "item B08XPWDSWW here", "nothing", "ABCDEFGHIJ /dp/B08XPWDSWW"]
    assert values(spark, texts, "string", web.product_id) == ["B08XPWDSWW"] * 6 + [None, "B08XPWDSWW"]


def test_magic(spark):
    data = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n00", b"GIF89a", b"II*\x00", b"MM\x00*", b"RIFF0000WEBPVP8 ", b"<html>", b"", b"RIFF0000WAVE"]
    rows = spark.createDataFrame([(bytearray(d),) for d in data], "x binary")
    assert [r.y for r in rows.select(web.sniff(F.col("x")).alias("y")).collect()] == ["image/jpeg", "image/png", "image/gif", "image/tiff", "image/tiff", "image/webp", None, None, None]


def test_addresses():
    assert web.forbidden_reason("8.8.8.8") is None and web.forbidden_reason("2606:4700:4700::1111") is None
    for address in ("127.0.0.1", "169.254.169.254", "10.0.0.1", "::1", "::ffff:127.0.0.1", "100.64.0.1", "224.0.0.1", "0.0.0.0", "no address", None, "fe80::1"):
        assert web.forbidden_reason(address), address


def test_addresses_as_by_the_standard_library():
    rng = random.Random(1)
    values = [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(3000)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(500)]
    for _, nets in web.NETWORKS:
        for net in map(ipaddress.ip_network, nets.split()):
            values += [net.network_address, net.broadcast_address]
    for ip in values:
        ip = getattr(ip, "ipv4_mapped", None) or ip
        kinds = [k for k in ("loopback", "link_local", "multicast", "unspecified", "reserved", "private") if getattr(ip, f"is_{k}")]
        assert web.forbidden_reason(str(ip)) == (kinds[0] if kinds else None if ip.is_global else "not globally routable"), ip


def test_gallery(spark):
    cdn = "https://m.media-amazon.com/images/I/"
    blob = "'colorImages': { 'initial': A.$.parseJSON('[{\"hiRes\":null,\"large\":\"%sA._S_.jpg\"},{\"hiRes\":\"%sB.png\",\"large\":\"%sC.jpg\"},{\"hiRes\":\"%sx.gif\"},{\"hiRes\":\"%sB.png\"}]')" % ((cdn,) * 5)
    pages = [blob, f"<img src='{cdn}A._S_.jpg'><img src='{cdn}A.jpg'>", "<h1>Robot Check</h1>", "", None]
    assert values(spark, pages, "string", web.gallery)[0] == [f"{cdn}A.jpg", f"{cdn}B.png"]
    assert values(spark, pages, "string", web.page_status) == ["ok", "partial", "blocked", "empty", "empty"]
