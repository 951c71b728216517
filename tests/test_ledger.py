"""Literal cases of dates, coverage, filters, the language, text, rules, clustering and streaming."""

import json
from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import dates, extract, text
from tallyspark.operators import clustering, joins, matching, predicates
from tallyspark.operators import mutations as mu
from tallyspark.operators import windows as wi
from tallyspark.plans import dsl
from tallyspark.sources import backup, messages, rules
from tallyspark.streaming import ingest

STAR = "스타벅스"
SAMPLES = [
    ("16449999", "KB", f"[KB]04/24 13:45\n1234*5678\n{STAR}출금\n12,300\n잔액100,000", r"^\[KB\](?<date>\d\d/\d\d \d\d:\d\d)\n\d+\*\d+\n(?<store>.+?)출금\n(?<amount>[\d,]+)\n", "expense"),
    ("15447200", "신한카드", f"신한카드(1234)승인 홍길동 12,300원(일시불)04/24 13:45 {STAR} 누적100,000원", r"^(?<card>신한카드)\(\d+\)승인 \S+ (?<amount>[\d,]+)원\(\S+\)(?<date>\d\d/\d\d \d\d:\d\d) (?<store>.+?) 누적", "expense"),
    ("15776200", "현대카드", f"현대카드 홍길동 승인\n홍길동\n12,300원 일시불\n04/24 13:45\n{STAR}\n누적100,000원", r"^(?<card>현대카드) \S+ 승인\n\S+\n(?<amount>[\d,]+)원 \S+\n(?<date>\S+ \S+)\n(?<store>[^\n]+)\n누적", "expense"),
    ("15888900", "삼성", f"삼성1234승인 홍길동\n12,300원 일시불\n04/24 13:45 {STAR}\n누적100,000원", r"^(?<card>삼성)\d+승인 \S+\n(?<amount>[\d,]+)원 \S+\n(?<date>\d\d/\d\d \d\d:\d\d) (?<store>[^\n]+)\n누적", "expense"),
    ("15888100", "롯데", f"{STAR}\n12,300원 승인\n홍길동 롯데1234*5678*\n일시불 04/24 13:45\n누적100,000원", r"^(?<store>[^\n]+)\n(?<amount>[\d,]+)원 승인\n\S+ (?<card>롯데)[\d*]+\n\S+ (?<date>\d\d/\d\d \d\d:\d\d)", "expense"),
    ("15889955", "우리카드", f"안내 ● 우리카드 이용안내\n우리(1234)승인\n홍길동님\n12,300원 일시불\n04/24 13:45\n{STAR}\n누적100,000원", r"(?<card>우리카드) 이용안내\n우리\(\d+\)승인\n\S+\n(?<amount>[\d,]+)원 \S+\n(?<date>\S+ \S+)\n(?<store>[^\n]+)\n", "expense"),
    ("15881600", "NH카드", f"NH카드1*2*승인\n홍길동\n12,300원 체크\n04/24 13:45\n{STAR}\n잔액100,000원", r"^(?<card>NH카드)[\d*]+승인\n\S+\n(?<amount>[\d,]+)원 \S+\n(?<date>\S+ \S+)\n(?<store>[^\n]+)\n", "payment"),
    ("15220080", "스마일카드", f"스마일카드승인 홍길동 12,300원 일시불 04/24 13:45 {STAR} 누적100,000원", r"^(?<card>스마일카드)승인 \S+ (?<amount>[\d,]+)원 \S+ (?<date>\d\d/\d\d \d\d:\d\d) (?<store>.+?) 누적", "expense"),
]
RECEIVED = 1777038300000  # 2026-04-24 13:45 UTC


def rule_file():
    body = {}
    for sender, _, _, pattern, kind in SAMPLES:
        body.setdefault(sender, {}).setdefault(kind, {})["k" + sender] = {
            "priority": 900, "bodyRegex": pattern, "amountGroup": "amount", "storeGroup": "store", "cardGroup": "card", "dateGroup": "date", "status": "ACTIVE", "source": "asset", "version": 1,
        }
    return json.dumps({"version": 1, "sms_rules": body}, ensure_ascii=False)


def test_rules_read_all_issuers(spark):
    table = rules.indexed(rules.flatten(spark.createDataFrame([(rule_file(),)], "json string")))
    assert table.count() == 8
    m = spark.createDataFrame([(str(i), body, sender, RECEIVED) for i, (sender, _, body, _, _) in enumerate(SAMPLES)], "id string, body string, address string, date long")
    attempts = matching.match_rules(m, matching.tuned_rules(table, RECEIVED))
    got = {r["id"]: r for r in matching.first_matches(attempts).collect()}
    assert len(got) == 8
    for i, (_, card, _, _, _) in enumerate(SAMPLES):
        r = got[str(i)]
        assert (r["amount"], r["storeName"], r["dateTime"], r["cardName"]) == (12300, STAR, "2026-04-24 13:45", card)
    counted = mu.record_attempts(table, attempts.select("senderAddress", "type", "ruleKey", "matched"), RECEIVED)
    assert counted.filter("matchCount = 1 AND failCount = 0").count() == 8


@pytest.mark.parametrize(
    "year,month,day,start,end",
    [
        (2026, 2, 1, "2026-02-01", "2026-02-28"), (2024, 2, 1, "2024-02-01", "2024-02-29"), (2026, 2, 19, "2026-01-19", "2026-02-18"), (2025, 12, 19, "2025-11-19", "2025-12-18"),
        (2026, 1, 19, "2025-12-19", "2026-01-18"), (2026, 3, 25, "2026-02-25", "2026-03-24"), (2026, 3, 30, "2026-02-28", "2026-03-29"), (2026, 2, 18, "2026-01-18", "2026-02-17"),
        (2025, 12, 1, "2025-12-01", "2025-12-31"),
    ],
)
def test_billing_month(year, month, day, start, end):
    a, b = dates.billing_month(year, month, day)
    assert (a.isoformat(), b.isoformat()) == (f"{start}T00:00:00", f"{end}T23:59:59.999000")


@given(st.integers(2000, 2050), st.integers(1, 12), st.integers(1, 28))
def test_billing_months_join(year, month, day):
    y, m = (year + 1, 1) if month == 12 else (year, month + 1)
    gap = dates.billing_month(y, m, day)[0] - dates.billing_month(year, month, day)[1]
    assert gap.total_seconds() == 0.001


def ms(text):
    return int((datetime.fromisoformat(text) - datetime(1970, 1, 1)).total_seconds() * 1000)


def test_coverage_cases(spark):
    target = spark.createDataFrame([(1, ms("2026-04-01"), ms("2026-04-24 23:59:59.999"))], "id int, start long, end long")
    until = ms("2026-04-24 10:00:00")
    one = lambda *r: spark.createDataFrame(list(r), "start long, end long")
    status = lambda f, c: f(target, c).first()["status"]
    assert status(wi.coverage_by_day, one((ms("2026-04-01"), until))) == "FULL"
    assert status(wi.coverage, one((ms("2026-04-01"), until))) == "PARTIAL"
    assert status(wi.coverage_by_day, one((ms("2026-04-02"), until))) == "PARTIAL"
    assert status(wi.coverage, one((0, 5))) == "NONE"


def rows(spark, n=12):
    data = [(i, i * 100, f"shop {i % 3}", "식비" if i % 2 else "교통", "KB", datetime(1998, 1, 1 + i % 5), None if i % 4 else "note", "EXPENSE", "", False) for i in range(1, n + 1)]
    return spark.createDataFrame(data, "id long, amount long, storeName string, category string, cardName string, ts timestamp_ntz, memo string, transaction_type string, transfer_direction string, is_fixed boolean")


def test_language_quirks(spark):
    e = rows(spark)
    book = dsl.Ledger(e, now=datetime(1998, 2, 1))
    span = {"startDate": "1998-01-01", "endDate": "1998-01-31", "type": "analytics"}
    assert dsl.run(dsl.Query(**span, filters=(dsl.Filter("planet", "==", 1),)), book).first()["count"] == 12
    empty = dsl.run(dsl.Query(**span, filters=(dsl.Filter("amount", "<", 0),)), book).collect()
    assert [tuple(r) for r in empty] == [("전체", 0, 0)]
    assert dsl.run(dsl.Query(**span, filters=(dsl.Filter("amount", "<", 0),), groupBy="category"), book).count() == 0
    count = lambda *f: dsl.run(dsl.Query(**span, filters=f), book).first()["count"]
    assert count(dsl.Filter("cardName", "in", ["kb"])) == 12 and count(dsl.Filter("category", "in", ["식비"])) == 6
    assert count(dsl.Filter("memo", "not_contains", "NOTE")) == 9 and count(dsl.Filter("amount", ">=", "abc")) == 12
    assert dsl.parse("no json") is None and dsl.parse("{broken") is None
    assert dsl.parse('say {"queries":[{"type":"card_list"}]} ok').queries[0].type == "card_list"
    assert {r["part"] for r in dsl.answer("?", dsl.Ledger(e, now=datetime(1998, 1, 20)))[0].collect()} == {"total", "category", "recent"}


def test_actions_with_what_they_lack_change_nothing(spark):
    book = dsl.Ledger(rows(spark), now=datetime(1998, 2, 1))
    for a in (dsl.Action("update_category", expenseId=1), dsl.Action("update_amount", expenseId=1, newAmount=0), dsl.Action("add_expense", storeName="x"), dsl.Action("unknown")):
        _, new, n = dsl.apply(a, book)
        assert n.first()["affected"] == 0 and new.exceptAll(book.expenses).count() == 0
    _, new, n = dsl.apply(dsl.Action("delete_expense", expenseId=3), book)
    assert n.first()["affected"] == 1 and new.count() == 11


def test_duplicates_are_removed_once(spark):
    e = rows(spark).unionByName(rows(spark).withColumn("id", F.col("id") + 100))
    once, n = mu.delete_duplicates(e)
    assert n.first()["affected"] == 12
    assert mu.delete_duplicates(once)[1].first()["affected"] == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1000)), max_size=20))
def test_running_total_never_falls(spark, data):
    e = spark.createDataFrame([(a, datetime(1998, 1, 1 + d)) for d, a in data], "amount long, ts timestamp_ntz")
    curve = [r["cumulative"] for r in wi.cumulative(e, date(1998, 1, 1), 10).orderBy("day").collect()]
    assert curve[0] == 0 and curve == sorted(curve) and curve[-1] == sum(a for _, a in data) and len(curve) == 11


def test_classification(spark):
    bodies = {
        "[KB]04/24 13:45\n스타벅스출금\n12,300\n잔액100,000": "PAYMENT", "신한카드 승인취소 12,300원": "INCOME", "국민은행 급여 2,000,000원 입금": "INCOME", "": "SKIP", "신한 입금되었습니다 100원": "SKIP",
        "hello 12,300원": "SKIP", "우리카드 자동이체출금 예정 5,000원": "SKIP", "하나카드 5,000원": "PAYMENT",
    }
    m = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert {r["body"]: r["type"] for r in predicates.classified(m).collect()} == bodies
    assert predicates.classified(m, ("hello",)).filter("reason = 'userExcludeKw[hello]'").count() == 1


def test_prefilter(spark):
    keep = ["신한카드 승인 12,300원 스타벅스 04/24 13:45", "보험금 입금 완료 우리은행 50,000원 안내"]
    drop = ["[광고] 신한카드 이벤트 12,300원 혜택", "짧다 12원", "신한카드 승인거절 12,300원 입금 한도초과", "https://a.b 에서 12,300원 혜택을 받아 가세요"]
    m = spark.createDataFrame([(b,) for b in keep + drop], "body string")
    assert {r["body"] for r in predicates.prefiltered(m).collect()} == set(keep)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.normalize_sender(F.lit("+82-10 1234(5678)"))) == "01012345678"
    assert one(text.normalize_sender(F.lit("8215881234"))) == "8215881234" and one(text.normalize_sender(F.lit("821012345678"))) == "01012345678"

    def java(s):
        h = 0
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    for s in ("", "abc", "스타벅스 12,300원", "emoji 😀 tail"):
        assert one(text.java_hash(F.lit(s))) == java(s)
    assert one(text.normalize_card(F.lit("KB국민카드"))) == "KB국민" and one(text.normalize_card(F.lit(" mystery "))) == "mystery"
    assert one(text.card_with_fallback(F.lit("[Web발신]"), F.lit("[NH] 승인"))) == "NH농협"
    assert "{AMOUNT}원" in one(text.templatize(F.lit("[신한] 02/05 스타벅스 11,940원 승인 / 잔액 100,000원")))
    assert one(text.templatize(F.lit("[KB]02/05 22:47\n1234*567\n스타벅스\n체크카드출금\n11,940\n잔액100,000"))) == "[KB]{DATE} {TIME}\n{CARD_NUM}\n{STORE}\n체크카드출금\n{AMOUNT}\n잔액{BALANCE}"
    assert one(text.loosely_equal(F.lit("abcdefgh"), F.lit("abcdefghij"))) and not one(text.loosely_equal(F.lit("abc"), F.lit("xyz")))
    words = {"카페/간식": ("스타벅스",), "식비": ("강남",)}
    assert one(text.infer_category(F.lit("스타벅스 강남"), F.lit(""), words)) == "카페/간식" and one(text.infer_category(F.lit("zz"), F.lit("강남"), words)) == "식비"
    assert one(text.infer_category(F.lit("스타벅스 강남"), F.lit(""))) == "미분류"
    assert one(text.pre_classify(F.lit("Netflix.com"))) == "구독" and one(text.canonical_store(F.lit("STARBUCKS 강남점"))) == "스타벅스"
    assert one(text.is_transfer_name(F.lit("하*현"))) and not one(text.is_transfer_name(F.lit("쿠팡")))
    assert one(text.csv_field(F.lit('a,"b'))) == '"a,""b"' and one(text.short_title(F.lit("x" * 31))) == "x" * 30 + "..."
    assert one(text.normalize_category(F.lit("배달 음식"))) == "식비" and one(text.normalize_category(F.lit("??"))) == "기타"


def test_extraction(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    at = lit("2026-04-24 08:00:00").cast("timestamp_ntz")
    r = one(extract.parsed(lit("[KB]04/25 13:45\n스타벅스\n12,300원"), at, lit(r"([\d,]+)원"), lit(r"\n([^\n]+)\n"), lit("")))
    assert (r["amount"], r["storeName"], r["cardName"], r["dateTime"]) == (12300, STAR, "KB", "2026-04-25 13:45")
    assert one(extract.parsed(lit("nothing"), at, lit(r"([\d,]+)원"), lit(r"\n([^\n]+)\n"), lit(""))) is None
    assert one(extract.income_amount(lit("[KB]\n입금\n50,000\n잔액1,000,000"))) == 50000 and one(extract.income_amount(lit("없음"))) == 0
    assert one(extract.income_type(lit("급여 입금"))) == "급여" and one(extract.income_type(lit("결제취소"))) == "환불"
    assert one(extract.income_source(lit("[KB]02/05 22:47\n123**456\n홍길동\n입금\n50,000"))) == "홍길동"
    assert one(extract.income_source(lit("김철수님으로부터 5,000원"))) == "김철수" and one(extract.income_source(lit("x"))) == ""
    assert one(extract.grounded(lit("스타 벅스 12,300원"), lit(12300), lit("스타벅스"))) and not one(extract.grounded(lit("112,300원 a"), lit(12300), lit("a")))
    assert one(dates.body_time(lit("13/45 25:10"), at)) == datetime(2027, 2, 15, 1, 10)
    assert one(dates.strict_body_time(lit("4월 3일 99:10"), at)) == "2026-04-03 08:10"
    assert one(dates.corrected_year(lit("2023-04-20 10:00:00").cast("timestamp_ntz"), at)) == datetime(2026, 4, 20, 10)
    for raw, want in (("plain", "plain"), ('{"text":"hi"}', "hi"), ('{"a":{"b":{"title":"deep"}}}', "deep"), ('{"layout":{"children":[{"widget":"TextView","text":"v"}]}}', "v"), ("{bad", "{bad")):
        assert one(extract.rich_text(lit(raw))) == want
    assert extract.group_index(r"(a)(?:b)(?<store>c)\((?<amount>d)", "amount") == 3 and extract.group_index("(x)", "1") == 1 and extract.group_index("(x)", "no") == 0


def test_nearest_and_all(spark):
    a = spark.createDataFrame([(1, "k", 10_000), (2, "k", 90_000)], "id long, content_key string, message_ms long")
    b = spark.createDataFrame([(7, "k", 1_000), (8, "k", 19_000), (9, "z", 10_000), (6, "k", 20_000)], "id long, content_key string, message_ms long")
    assert [tuple(r) for r in joins.nearest(a, b).collect()] == [(1, 7, 9000)]
    assert {r["other_id"] for r in joins.near(a, b).collect()} == {6, 7, 8}


def test_channels(spark):
    parts = spark.createDataFrame([(1, 2, "text/plain", "lo"), (1, 1, "text/plain", "hel"), (1, 3, "image/png", "x")], "mms_id int, part int, content_type string, text string")
    senders = spark.createDataFrame([(1, 0, 151, "15881111"), (1, 1, 137, "15882222")], "mms_id int, row int, kind int, address string")
    got = messages.scan_mms(spark.createDataFrame([(1, 100), (2, 999)], "mms_id int, date long"), parts, senders, 100_000, 100_999)
    assert [(r["body"], r["address"], r["date"]) for r in got.collect()] == [("hello", "15882222", 100_000)]
    sms = spark.createDataFrame([("a", "x", 5), ("010-1", "y", 5), ("a", None, 5), ("b", "z", 5)], "address string, body string, date long")
    assert [r["address"] for r in messages.scan_sms(sms, 0, 9, spark.createDataFrame([("b",)], "address string")).collect()] == ["a"]


def test_clustering(spark):
    u = clustering.unit_rows([[1, 0], [0.99, 0.1], [0, 1], [0.05, 1], [1, 0.02]])
    assert clustering.greedy(u, 0.95) == [[0, 1, 4], [2, 3]]
    assert clustering.merged(clustering.unit_rows([[1, 0], [1, 0], [0.99, 0.1]]), [[0, 1], [2]]) == [[0, 1, 2]]
    data = [(i, i, "s", [1.0, 0.01 * i], "t") for i in range(4)] + [(9, 9, "s", [0.0, 1.0], "z")]
    out = clustering.cluster(spark.createDataFrame(data, "id long, position long, sender string, vector array<double>, template string"), "sender", "seeded", 0.95)
    assert sorted((r["id"], r["size"]) for r in out.collect()) == [(0, 4), (1, 4), (2, 4), (3, 4), (9, 1)]


@pytest.mark.parametrize("mode", ["seeded", "greedy"])
def test_clustering_of_a_large_sender(spark, mode):
    # 20,100 near rows, of one large template and a hundred single ones, and eight far ones: two groups
    near = F.array(F.lit(1.0), F.col("id") % 7 * 0.001)
    rows = spark.range(20_108).select(
        "id", F.col("id").alias("position"), F.lit("s").alias("sender"), F.when(F.col("id") < 20_100, near).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"),
        F.when(F.col("id") < 20_000, "t").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("template"),
    )
    got = clustering.source_groups(clustering.cluster(rows, "sender", mode, 0.95)).collect()
    assert [tuple(r) for r in got] == [("s", 2, 20_108, 20_100, 99)]


def test_backup_round_trip(spark, tmp_path):
    e = rows(spark)
    backup.write_backup(e, str(tmp_path / "b"))
    back = backup.read_backup(spark, str(tmp_path / "b"), e)
    assert back.exceptAll(e).count() == 0 and e.exceptAll(back).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    bodies = [s[2] for s in SAMPLES] + ["[광고] 신한카드 이벤트 12,300원 혜택"]
    data = [(f"m{i}", b, "15881234", RECEIVED + i) for i, b in enumerate(bodies)]
    table = spark.createDataFrame(data + data[:3], "id string, body string, address string, date long")
    table.coalesce(1).write.json(str(tmp_path / "in"))
    seen: list = []
    stream = spark.readStream.schema("id string, body string, address string, date long").json(str(tmp_path / "in"))
    ingest.ingest(stream, lambda df, _: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    batch = [r["id"] for r in ingest.transform(table.dropDuplicates(["id"])).collect()]
    assert sorted(seen) == sorted(batch) and len(seen) == len(set(seen)) > 0


def test_vectors(spark):
    from tallyspark.functions.vectors import cosine

    one = lambda a, b: spark.range(1).select(cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("x")).first()["x"]
    assert one([1.0, 0.0], [1.0, 0.0]) == 1.0 and one([1.0], [1.0, 2.0]) == 0.0 and one([0.0, 0.0], [1.0, 2.0]) == 0.0
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=8), rng.normal(size=8)
    assert one(a.tolist(), b.tolist()) == pytest.approx(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), abs=1e-6)


def test_csv_files_join_to_one(spark, tmp_path):
    from tallyspark.sources.backup import write_csv

    lines = spark.createDataFrame([(f"line {i}", i, i) for i in range(50)], "line string, ts long, id long").repartition(5)
    for _ in range(2):  # writing again replaces
        write_csv(lines, "a,b", f"{tmp_path}/out")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").iterdir()) if p.name[0] not in "._")
    assert whole.decode("utf-8-sig").splitlines() == ["a,b", *(f"line {i}" for i in reversed(range(50)))]


def test_income_sources_of_several_marks(spark):
    from tallyspark.functions import extract

    one = lambda t: spark.range(1).select(extract.income_source(F.lit(t))).first()[0]
    assert one("입금\n홍길동\n입금\n100") == "홍길동" and one("김철수\n입금\n홍길동\n입금") == "김철수"
    assert one("[Web발신]\n입금\n12/01 10:11\n입금") == "입금" and one("입금 10000") in ("10000", "")


def test_dictionary_of_categories(spark, tmp_path):
    from tallyspark.sources.rules import category_words

    (tmp_path / "words.json").write_text('{"b": ["x", "y"],\n "a": ["z"]}')
    assert list(category_words(spark, str(tmp_path / "words.json")).items()) == [("b", ("x", "y")), ("a", ("z",))]


def test_notifications_of_equal_worth(spark):
    from tallyspark.operators.predicates import best_notification

    rows = [(1, "결제 100원"), (1, "결제 200원"), (1, " "), (2, "none"), (3, "")]
    got = {r["note_id"]: r["body"] for r in best_notification(spark.createDataFrame(rows, "note_id int, body string")).collect()}
    assert got == {1: "결제 100원", 2: "none"}


@pytest.mark.parametrize("few", [0, 64])
def test_names_and_keywords_by_pieces(spark, monkeypatch, few):
    """Many rules and mappings are found by equal pieces, a few are tried each by each; both are what plain loops find."""
    monkeypatch.setattr(predicates, "FEW", few)
    names = ["", "a", "Ab", "abab", "bAb a", "카페 봄", "봄", "😀x", "zz", None, "abab"]
    words = ["ab", "B", "", "봄", "😀", "ABABAB", "카페 봄날", None, "q"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, storeName string")
    rules = spark.createDataFrame([(k, w, f"c{k}", False, 10 - k % 3) for k, w in enumerate(words)], "id int, keyword string, category string, isFixed boolean, createdAt long")
    got = {r["id"]: r["rule_category"] for r in joins.store_rules(rows, rules).collect()}
    held = lambda n: [(10 - k % 3, k) for k, w in enumerate(words) if n is not None and w is not None and w.lower() in n.lower()]
    assert got == {i: f"c{max(held(n))[1]}" if held(n) else None for i, n in enumerate(names)}
    mappings = [w for w in words if w]
    table = spark.createDataFrame([(w, f"c{w}") for w in mappings], "storeName string, category string")
    found = {r["id"]: r["mapped_category"] for r in joins.mapped_category(rows, table).collect()}

    def mapped(n):
        if n is None:
            return None
        hits = [n] if n in mappings else [w for w in mappings if w in n or n in w]
        return f"c{min(hits, key=lambda w: w.encode())}" if hits else None

    assert found == {i: mapped(n) for i, n in enumerate(names)}
    excluded = spark.createDataFrame([("AB",), ("",), ("봄",), (None,), ("ab",)], "keyword string")
    left = {r["id"] for r in predicates.without_keywords(rows, "storeName", excluded).collect()}
    assert left == {i for i, n in enumerate(names) if n is None or not any(w in n.lower() for w in ("ab", "봄"))}


@pytest.mark.parametrize("best", [False, True])
def test_near_pairs_within_keys(spark, monkeypatch, best):
    """Vectors of a key meet in blocks, whatever its size; null keys and vectors and other lengths meet nothing."""
    monkeypatch.setattr(matching, "BLOCK", 7)
    rng = np.random.default_rng(5)
    data = [(i, "hot" if i % 3 else f"k{i % 5}", rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(60)]
    data += [(60, None, [1.0, 0.0, 0.0]), (61, "hot", None), (62, "hot", [1.0, 0.0]), (63, "hot", [0.0, 0.0, 0.0]), (64, "alone", [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame(data, "id long, label string, vector array<double>")
    side = lambda name: rows.select(F.col("id").alias(name), "label", "vector")
    got = matching.near_pairs(side("left_id"), side("right_id"), None if best else 0.5, best, True, ("label",)).collect()

    def cosine(u, v):
        scale = np.linalg.norm(u) * np.linalg.norm(v)
        return round(float(np.dot(u, v) / scale), 6) if scale else 0.0

    want = {(i, j): cosine(u, v) for i, k, u in data for j, l, v in data if i != j and k is not None and k == l and u and v and len(u) == len(v)}
    if best:
        want = {p: s for p, s in want.items() if (-s, p[1]) == min((-t, q[1]) for q, t in want.items() if q[0] == p[0])}
    else:
        want = {p: s for p, s in want.items() if s >= 0.5}
    assert {(r["left_id"], r["right_id"]): r["similarity"] for r in got} == pytest.approx(want, abs=1e-6) and len(got) == len(want)


@pytest.mark.parametrize("kind", ["table", "stream"])
def test_late_matches(spark, tmp_path, kind):
    """Notifications meet messages by equal ends within stretches of time, on tables and streams; they are what plain loops find."""
    bodies = ["", "a", "aa", "aaaa", "aaaaaaa", "승인 12,300원", "[KB]승인 12,300원 잔액", "😀봄😀봄", "봄😀", None, "300원 잔액"]
    times = [RECEIVED + x for x in (0, 120_000, 120_001, -120_000, -120_001, 250_000)]
    notes = [(i * 10 + j, b, t) for i, b in enumerate(bodies) for j, t in enumerate(times[::2])] + [(900, "a", None)]
    stored = [(i * 10 + j, b, t) for i, b in enumerate(bodies) for j, t in enumerate(times)] + [(901, "a", None)]
    tables = []
    for name, data, columns in (("notes", notes, "note_id long, body string, ts_ms long"), ("stored", stored, "id long, body string, date long")):
        table = spark.createDataFrame(data, columns)
        if kind == "stream":
            table.coalesce(1).write.json(f"{tmp_path}/{name}")
            table = spark.readStream.schema(columns).json(f"{tmp_path}/{name}")
        tables.append(table)
    found = ingest.late_matches(*tables)
    got: list = []
    if kind == "stream":
        found.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(180)
    else:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = found.collect()
    want = [(n, m) for n, b, t in notes for m, c, u in stored if None not in (b, c, t, u) and b in c and abs(t - u) <= 120_000]
    assert sorted((r["note_id"], r["message_id"]) for r in got) == sorted(want) and len(want) > 100


def test_match_patterns_in_blocks(spark, monkeypatch):
    """A sender's messages and patterns meet in blocks, not pair by pair; odd vectors count as plain loops say."""
    monkeypatch.setattr(matching, "BLOCK", 7)
    monkeypatch.setattr(matching, "ROWS", 3, raising=False)
    rng, nan = np.random.default_rng(8), float("nan")
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, nan, 0.0], [float("inf"), 1.0, 1.0], [1.0, None, 2.0], [-1.0, 1.0]]
    vectors = lambda n: [rng.integers(-3, 4, 3).astype(float).tolist() for _ in range(n)] + odd
    senders = ["1588-1", "1588.2", "1588-3"]
    mine = [(i, "1588-9" if i % 4 == 3 else senders[i % 4], v) for i, v in enumerate(vectors(90) + odd * 3)]
    theirs = [(1000 + i, senders[i % 2], v) for i, v in enumerate(vectors(40) + odd)] + [(2000, senders[2], [nan, 1.0, 1.0])]
    m = spark.createDataFrame(mine, "id long, address string, vector array<double>")
    p = spark.createDataFrame(theirs, "patternId long, senderAddress string, vector array<double>")
    found = matching.match_patterns(m, p)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    sound = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)

    def similarity(u, v, known):
        if u is None or v is None or len(u) != len(v):
            return 0.0 if known else None
        if not (sound(u) and sound(v)):
            return nan if known else None
        scale = np.linalg.norm(u) * np.linalg.norm(v)
        return round(float(np.dot(u, v) / scale), 6) if scale else 0.0

    want = {}
    for i, sender, u in mine:
        known = sender != "1588-9"
        pairs = [(s, r) for r, t, v in theirs if (t == sender or not known) and (s := similarity(u, v, known)) is not None]
        if pairs:
            s, r = min(pairs, key=lambda x: (np.isnan(x[0]), 0 if np.isnan(x[0]) else -x[0], x[1]))
            want[i] = (r, s)
    got = found.collect()
    assert len(got) == len(want) > 90
    assert {r["left_id"]: (r["right_id"], repr(round(r["similarity"], 6) + 0.0)) for r in got} == {i: (r, repr(s + 0.0)) for i, (r, s) in want.items()}
