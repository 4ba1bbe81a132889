import datetime as dt

from pyspark.sql import functions as F

from tidewell.functions import dates, keys, scores, text


def values(spark, column, rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_repair_mojibake(spark):
    broken = "cafÃ©"
    assert values(spark, text.repair_mojibake("s"), [broken, "café", "ığ", None, ""]) == ["café", "café", "ığ", None, ""]


def test_clean_text(spark):
    rows = ["  - a  b / ", "WhatsApp - Twitle | news here", "+3 video için play'e tıklayın - haber", "  ", None, "x"]
    assert values(spark, text.clean_text("s"), rows) == ["a b", "news here", "haber", None, None, "x"]


def test_fold_and_suffixes(spark):
    assert values(spark, text.fold("s"), ["İZMİT'te  Çayır-ova", "Ağaç’ın"]) == ["izmitte cayir ova", "agacin"]
    assert values(spark, text.strip_suffix("s"), ["Gebze'de", "Gebzeden", "İzmitteki", "ev"]) == ["Gebze", "Gebze", "İzmit", "ev"]
    assert values(spark, text.normalize_token("s"), ["Trafik  Kazası", "a-b__c"]) == ["trafik_kazasi", "a_b_c"]


def test_hashes(spark):
    import hashlib

    row = spark.createDataFrame([(" t ", "b\n", None)], "t string, b string, s string")
    got = row.select(keys.content_hash("t", "b"), keys.dedupe_hash("t", "b", "s"), keys.idempotency_key(F.lit("x"), F.lit("u"))).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert list(got) == [sha("t\nb"), sha("b"), sha("x::u")]


def test_urls(spark):
    base = "https://www.a.com/x/y?q=1"
    cases = {"/z#f": "https://www.a.com/z#f", "z": "https://www.a.com/x/z", "//b.c/d": "https://b.c/d", "http://e/f": "http://e/f", "": base}
    assert values(spark, keys.absolute_url(F.lit(base), "s"), list(cases)) == list(cases.values())
    assert values(spark, keys.normalize_url("s"), ["http://a/b/#c", "http://a//"]) == ["http://a/b", "http://a"]
    assert values(spark, keys.site_key("s"), ["https://www.haber.com.tr/x", "blog.site.org"]) == ["haber", "blog"]
    assert values(spark, keys.html_to_text("s"), ["<p>a<b>b</b></p><script>x</script> &amp; c"]) == ["a b & c"]


def test_dates(spark):
    rows = ["2024-01-02T03:04:05+03:00", "2024-01-02", "2024-01-02T03:04:05", "12 Ocak 2024 10:30", "31 Şubat 2024", "nonsense", None]
    utc = [None if v is None else v.replace(tzinfo=None) for v in values(spark, dates.parse_published("s").cast("timestamp_ntz"), rows)]
    assert utc == [dt.datetime(2024, 1, 2, 0, 4, 5), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 12, 7, 30), None, None, None]


def test_scores(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])]
    got = values(spark, scores.cosine("a", "b"), pairs, "a array<double>, b array<double>")
    assert [None if v is None else round(v, 4) for v in got] == [1.0, 0.7071, 0.0, None]
    assert values(spark, scores.keyword_confidence("n"), [1, 2, 9], "n int") == [0.45, 0.55, 0.92]
    assert values(spark, scores.marker_radius("c"), [None, 80.0, 0.2], "c double") == [13.0, 16.0, 10.0]
    assert values(spark, scores.place_specificity("s"), ["Cumhuriyet Mahallesi, Gebze", "", None]) == [14, -1, -1]
    assert values(spark, scores.event_details("s"), ['{"a": "b"}', "bad", None]) == [{"a": "b"}, {}, {}]


def test_summaries(spark):
    long = "First one. " + "word " * 60
    got = spark.createDataFrame([(None, long), ("short.", None)], "s string, c string").select(text.executive_summary("s", "c", 40)).collect()
    assert [r[0] for r in got] == ["First one.", "short."]


def test_district_at_the_start_and_neighborhood(spark):
    rows = ["Izmit Merkez", "izmit", "Old Izmit", "GEBZE yolu", None, ""]
    assert values(spark, text.embedded_district("s", ["Gebze", "Izmit"]), rows) == ["Izmit", None, None, "Gebze", None, None]
    rows = [" Kent mahallesi ", "Kent Mah.5", "Kent Mah. 5", "mahallelik", None, ""]
    assert values(spark, text.extract_neighborhood("s", ["mahallesi", "mahalle", "mah."]), rows) == ["Kent mahallesi", "Kent Mah.5", None, None, None, None]


def test_fold_is_the_decomposition_without_marks(spark):
    import unicodedata

    from tidewell.operators.dictionary import fold_plain

    chars = [chr(i) for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00), (0x400, 0x460), (0xFB00, 0xFB07)) for i in range(lo, hi)] + ["Český Őr ﬁn", "İI ıi", "a’b-c  d\u0301", "ŉ ĳ ǆ"]
    got = dict(spark.createDataFrame([(c,) for c in chars], "c string").select("c", text.fold("c").alias("f")).collect())
    for c in chars:
        want = "".join(x for x in unicodedata.normalize("NFKD", c.replace("ı", "i")) if not unicodedata.combining(x)).lower()
        if len(c) == 1:
            assert got[c] == want.strip(), (hex(ord(c)), got[c], want)
        assert got[c] == fold_plain(c), (c, got[c], fold_plain(c))
    assert got["Český Őr ﬁn"] == "cesky or fin" and got["a’b-c  d\u0301"] == "ab c d"
