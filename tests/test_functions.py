"""Literal cases of the standard's rules, each for the Column expression that implements it."""

from datetime import date

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import charset, codec_math, matching, pixels, rle, values


def one(spark, **columns):
    """The single row of a DataFrame of expressions, computed over a real row so that nothing is folded away."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def results(spark, predicate, cases):
    df = spark.createDataFrame([(k, c) for k, (_, c, _) in enumerate(cases)], "k int, c string")
    checks = F.array(*[predicate(F.col("c"), key) for key, _, _ in cases])
    return [r.v for r in df.select("k", F.get(checks, F.col("k")).alias("v")).orderBy("k").collect()]


#: (key, value, does it match); wildcards are also held against a plain matcher of their own below
WILDCARDS = [
    ("", "no key matches all", True), ("CT*", "CT", True), ("CT*", "CTA chest", True), ("CT*", "MCT", False), ("?R", "MR", True), ("?R", "R", False), ("?R", "MRI", False),
    ("*^*^", "Okafor^Ada^", True), ("*^*^", "Okafor", False), ("knee", "Knee", False), ("50%", "50%", True), ("50%", "505", False), ("L_3", "L43", False), ("C\\D", "C\\D", True), ("K.", "Ks", False),
]
DATES = [
    ("", "19750630", True), ("-19750630", "19750630", True), ("-19750630", "19750701", False), ("19750630-", "19750629", False), ("19750630-", "20240229", True),
    ("19750101-19751231", "19750630", True), ("19750101-19751231", "19741231", False), ("19750101-19751231", "19760101", False), ("1975.06.30", "19750630", True),
    ("-1975", "19750630", False), ("1976-", "19760101", True), ("", "no date", False), ("junk-19750630", "19740101", True), ("19750630", None, False),
]
UIDS = [("", "2.25.9", True), ("2.25.1\\2.25.9", "2.25.9", True), ("2.25.1\\2.25.9", "2.25.19", False), ("2.25.9", "2.25.9", True)]


def plain_match(key, value):
    """Whether `value` fits a key of characters, ? and *, by looking at every way to cut it."""
    if not key:
        return not value
    if key[0] == "*":
        return any(plain_match(key[1:], value[k:]) for k in range(len(value) + 1))
    return bool(value) and key[0] in ("?", value[0]) and plain_match(key[1:], value[1:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aB?*%_\\.", min_size=1, max_size=7), st.text(alphabet="aB%_\\.", max_size=7)), min_size=5, max_size=25))
def test_wildcards_against_a_plain_matcher(spark, cases):
    assert results(spark, matching.wildcard, [(k, v, None) for k, v in cases]) == [plain_match(k, v) for k, v in cases]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.dates(date(1900, 1, 1), date(2099, 12, 31)), st.dates(date(1900, 1, 1), date(2099, 12, 31)), st.dates(date(1900, 1, 1), date(2099, 12, 31)), st.sampled_from(["{a}-{b}", "-{b}", "{a}-", "{a}"])), min_size=5, max_size=25))
def test_date_ranges_against_dates(spark, cases):
    da = lambda d: d.strftime("%Y%m%d")
    keyed = [(form.format(a=da(a), b=da(b)), da(d), {"{a}-{b}": a <= d <= b, "-{b}": d <= b, "{a}-": a <= d, "{a}": a == d}[form]) for a, b, d, form in cases]
    assert results(spark, matching.date_range, keyed) == [w for _, _, w in keyed]


def test_matching(spark):
    assert results(spark, matching.wildcard, WILDCARDS) == [w for _, _, w in WILDCARDS]
    assert results(spark, matching.date_range, DATES) == [w for _, _, w in DATES]
    assert results(spark, matching.uid_list, UIDS) == [w for _, _, w in UIDS]


def test_dates_and_times(spark):
    da = {"19990704": (1999, 7, 4), "1999": (1999, 0, 0), "199907": (1999, 7, 0), "1999.07.04": (1999, 7, 4), "19997": None, "1999070": None, "July 4th": None}
    tm = {"081503.250000": (8, 15, 3, 250000), "08": (8, 0, 0, 0), "240000": None, "0815.2": (8, 15, 0, 0), "081561": None, "081503.25": (8, 15, 3, 250000)}
    dt = {"19990704081503.250000+0100": (1999, 8, 60), "19990704": (1999, None, None), "199907040815": (1999, 8, None), "19990704081503-0930": (1999, 8, -570), "noon": None}
    for cases, parse in ((da, values.parse_da), (tm, values.parse_tm), (dt, values.parse_dt)):
        df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", parse(F.col("c")).alias("v"))
        for r in df.collect():
            if parse is values.parse_dt and r.v is not None:
                assert (r.v.date.y, r.v.time and r.v.time.h, r.v.offset_min) == cases[r.c]
            else:
                assert (tuple(r.v) if r.v is not None else None) == cases[r.c], r.c


def test_uids_and_names(spark):
    good, bad = ["2.25.7", "0", "2.0.9", "2" * 64], ["", ".2.25", "2.25.", "2..25", "2.x.25", "2.25b", "2.025", "2.00.1", "2" * 65]
    df = spark.createDataFrame([(u,) for u in [*good, *bad, None]], "u string").select("u", values.uid_valid(F.col("u")).alias("v"))
    assert {r.u: r.v for r in df.collect()} == {**dict.fromkeys(good, True), **dict.fromkeys([*bad, None], False)}
    r = one(spark, g=values.person_groups(F.lit("Yamada^Tarou^M^Dr^II=山田^太郎=")), w=values.format_person(values.person_groups(F.lit("A^B=="))))
    assert tuple(r.g) == ("Yamada^Tarou^M^Dr^II", "山田^太郎", "") and r.w == "A^B"
    parts = [values.person_component(F.lit("Yamada^Tarou^M^Dr^II"), k) for k in range(6)]
    assert list(one(spark, **{f"c{k}": p for k, p in enumerate(parts)})) == ["Yamada", "Tarou", "M", "Dr", "II", ""]
    r = one(spark, x=values.xml_escape(F.lit("A<B>&C\"D'E")), n=values.format_number(F.lit(3.0)), m=values.format_number(F.lit(2.78)), u=values.uid_from_text("1.2", F.lit("a")))
    assert r.x == "A&lt;B&gt;&amp;C&quot;D&apos;E" and (r.n, r.m) == ("3.0", "2.78") and r.u.startswith("1.2.")


def test_window_and_masks(spark):
    w = lambda v: pixels.window(F.lit(float(v)), F.lit(128.0), F.lit(256.0))
    assert list(one(spark, a=w(-1), b=w(0), c=w(255), d=w(300), e=w(128))) == [0, 0, 255, 255, 128]
    r = one(spark, u=pixels.mask_unsigned(F.lit(0x0FF0), 8, 11), s=pixels.mask_signed(F.lit(0x0FFF), 12, 11), full=pixels.mask_signed(F.lit(-5), 16, 15))
    assert tuple(r) == (255, -1, -5)
    c, w = pixels.fallback_window(F.lit(5.0), F.lit(5.0))
    assert tuple(one(spark, c=c, w=w)) == (5.5, 1.0)


def test_geometry(spark):
    px = F.array(*map(F.lit, range(1, 7)))
    turned = {d: pixels.rotated(px, 2, 3, d) for d in (0, 90, 180, 270)}
    r = one(spark, **{f"r{d}": c for d, c in turned.items()}, h=pixels.flipped(px, 2, 3, True, False), v=pixels.flipped(px, 2, 3, False, True), both=pixels.flipped(px, 2, 3, True, True))
    assert (r.r0, r.r90, r.r180, r.r270) == ([1, 2, 3, 4, 5, 6], [4, 1, 5, 2, 6, 3], [6, 5, 4, 3, 2, 1], [3, 6, 2, 5, 1, 4])
    assert (r.h, r.v, r.both) == ([3, 2, 1, 6, 5, 4], [4, 5, 6, 1, 2, 3], [6, 5, 4, 3, 2, 1])
    square = F.array(*map(F.lit, [0, 64, 128, 255]))
    r = one(spark, c=pixels.cropped(square, 2, 2, 0.5, 0.5, 0.5, 0.5), same=pixels.bilinear(square, 2, 2, 2, 2), big=pixels.bilinear(F.array(F.lit(200)), 1, 1, 2, 2))
    assert (r.c, r.same, r.big) == ([255], [0, 64, 128, 255], [200] * 4)
    assert pixels.scaled_side(100, 300, 200) == 150
    with pytest.raises(ValueError):
        pixels.crop_bounds(2, 2, 0.6, 0, 0.5, 1)
    planes = F.array(*map(F.lit, [1, 2, 11, 12, 21, 22]))
    r = one(spark, i=pixels.planar_to_interleaved(planes, 2), p=pixels.interleaved_to_planar(pixels.planar_to_interleaved(planes, 2), 2))
    assert (r.i, r.p) == ([1, 11, 21, 2, 12, 22], [1, 2, 11, 12, 21, 22])


def test_palette_overlay_colour(spark):
    identity = F.array(*map(F.lit, range(256)))
    bits = F.array(F.lit(0b10000001))
    o = lambda r, c: pixels.overlay_bit(bits, F.lit(r), F.lit(c), 1, 8)
    assert list(one(spark, p=pixels.palette_entry(identity, F.lit(300), 0, 256, 8), a=o(0, 0), b=o(0, 7), c=o(0, 3), d=o(1, 0))) == [255, True, True, False, False]
    assert tuple(one(spark, **dict(zip("rgb", pixels.ybr_to_rgb(F.lit(100.0), F.lit(128.0), F.lit(128.0)))))) == (100, 100, 100)


def test_codec_arithmetic(spark):
    p = lambda *v: codec_math.med_predictor(*map(F.lit, v))
    assert list(one(spark, a=p(10, 20, 30), b=p(20, 30, 10), c=p(10, 20, 15))) == [10, 30, 15]
    q = [codec_math.quantized_gradient(F.lit(d), 3, 7, 21) for d in (0, 1, 3, 7, 21, -1, -3, -7, -21)]
    assert list(one(spark, **{f"q{k}": c for k, c in enumerate(q)})) == [0, 1, 2, 3, 4, -1, -2, -3, -4]
    ids = [codec_math.context_id(*[F.lit(v)] * 3) for v in (-4, 4)]
    assert list(one(spark, a=ids[0], b=ids[1])) == [-364, 364]
    e = spark.range(-50, 50).select(F.col("id").cast("int").alias("e")).withColumn("m", codec_math.mapped_error(F.col("e")))
    assert all(r.e == r.b and r.m >= 0 for r in e.select("e", "m", codec_math.unmapped_error(F.col("m")).alias("b")).collect())
    assert codec_math.jpeg_ls_defaults(255) == {"t1": 3, "t2": 7, "t3": 21, "range": 256, "bpp": 8, "qbpp": 8, "limit": 32}
    row = [3, 7, 1, 8, 2, 9, 4, 4]
    r = one(spark, w=codec_math.wavelet_53(F.array(*map(F.lit, row)), 8), one=codec_math.wavelet_53(F.array(F.lit(5)), 1))
    high = [row[2 * k + 1] - (row[2 * k] + row[min(2 * k + 2, 6)]) // 2 for k in range(4)]
    low = [row[2 * k] + (high[max(k - 1, 0)] + high[k] + 2) // 4 for k in range(4)]
    assert r.w == low + high and r.one == [5]


def test_rle_round_trips():
    import random

    rng = random.Random(1)
    for n, samples, width in ((0, 1, 1), (1, 1, 1), (700, 1, 1), (500, 3, 1), (300, 1, 2)):
        data = bytes(rng.choice([0, 0, 0, rng.randrange(256)]) for _ in range(n * samples * width))
        assert rle.decode_frame(rle.encode_frame(data, samples, width), n, samples, width) == data
    assert rle.pack(rle.np.frombuffer(b"\x05" * 130, rle.np.uint8)) == bytes([257 - 128, 5, 257 - 2, 5])
    assert bytes(rle.unpack(bytes([128, 2, 1, 2, 3, 254, 9]), 6)) == b"\1\2\3\x09\x09\x09"
    with pytest.raises(ValueError):
        rle.decode_frame(b"\2" + b"\0" * 63, 4, 1, 1)


def test_character_sets(spark):
    cases = [("ISO_IR 100", "Müller"), ("ISO_IR 101", "Łukasz^Żółć"), ("ISO_IR 144", "Люкceмбypг"), ("ISO_IR 192", "山田^太郎"), ("GB18030", "王^小东"), ("ISO_IR 126", "Διονυσιος"), ("ISO_IR 166", "นามสกุล")]
    for term, text in cases:
        assert charset.decode_bytes(charset.encode_text(text, term), term) == text
    jis = "Yamada^Tarou=".encode() + b"\x1b$B" + "山田".encode("iso2022_jp")[3:-3] + b"\x1b(B^" + b"\x1b$B" + "太郎".encode("iso2022_jp")[3:-3] + b"\x1b(B"
    assert charset.decode_bytes(jis, "\\ISO 2022 IR 87") == "Yamada^Tarou=山田^太郎"
    assert charset.decode_bytes(bytes.fromhex("4DFC6C6C6572"), "ISO_IR 100") == "Müller"
    with pytest.raises(LookupError):
        charset.codec_of("no such set")
    df = spark.createDataFrame([("Müller",), ("山",), (None,)], "t string")
    out = df.select("t", charset.decode(charset.encode(F.col("t"), "ISO_IR 101"), "ISO_IR 101").alias("b")).collect()
    assert {r.t: r.b for r in out} == {"Müller": "Müller", "山": None, None: None}
