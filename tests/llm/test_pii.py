from reckon.llm import pii


def found(spark, texts, kind):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [r.text[s.start : s.end] for s in r._rk_spans if s.kind == kind] for r in pii.pii_spans(df).collect()}
    return [got[i] for i in range(len(texts))]


def test_phones_without_adjacent_digits(spark):
    texts = ["+1.2.3.4.5.6.7.8", "call +4 (9) 1.7.6.1.2.3 now", "+1  5  5  5  0  1  0  9", "+ 1.2", "+1.2.3"]
    assert found(spark, texts, "phone") == [["+1.2.3.4.5.6.7.8"], ["+4 (9) 1.7.6.1.2.3"], ["+1  5  5  5  0  1  0  9"], [], []]


def test_ibans_end_at_the_length_of_their_country(spark):
    texts = {
        "BE68539007547034 Please pay": ["BE68539007547034"], "BE68 5390 0754 7034 Please": ["BE68 5390 0754 7034"],
        "AT611904300234573201 Wien": ["AT611904300234573201"], "ES9121000418450200051332 Para": ["ES9121000418450200051332"],
        "AT611904300234573201 VISA card": ["AT611904300234573201"], "BE68539007547034 12 May": ["BE68539007547034"],
        "NO93 8601 1117 947 OG": ["NO93 8601 1117 947"], "BE68539007547034BE68539007547034": [], "BE69539007547034 Please": [],
    }
    assert found(spark, list(texts), "iban") == list(texts.values())
