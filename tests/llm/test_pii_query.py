"""The counts of the query over personal data against its own spans."""

from relevara.llm import queries


def test_the_query_counts_spans_of_each_kind(spark, tmp_path):
    card, mail, ip, phone = "4111 1111 1111 1111", "a.b@c.de", "10.1.1.1", "+49 301234567"
    texts = [None, "", card, f"{card}, {card}", f"{mail} then {card}", f"{ip}; {mail}; {ip}", f"{phone}, {phone}, {mail}, {card}, {ip}", "256.1.1.1 +1 2 4111 1111 1111 1112"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op3_pii_sanitisation(spark, str(tmp_path)).collect()}
    want = [(0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 2, 0), (1, 0, 1, 0), (1, 2, 0, 0), (1, 1, 1, 2), (0, 0, 0, 0)]
    assert [tuple(rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")) for i in range(len(texts))] == want
    for r in rows.values():
        kinds = [s.split(":")[0] for s in r.spans.split(",")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
