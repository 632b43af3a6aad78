from hornbeam.operators.rules import to_rules

IRI = "<http://ex.org/kg#{}>"


def test_dedupe_render_thresholds(spark, kg):
    _, schema = kg
    i = IRI.format
    rows = [
        # body-swapped twins with equal scores collapse to one rule, larger atom first
        (i("did_view"), i("did_click"), i("did_purchase"), 5, 10, 4, 0.5, 1.25),
        (i("did_view"), i("did_purchase"), i("did_click"), 5, 10, 4, 0.5, 1.25),
        # different scores: both stay
        (i("did_click"), i("did_view"), i("did_error"), 5, 10, 4, 0.5, 1.25),
        (i("did_click"), i("did_error"), i("did_view"), 6, 10, 4, 0.6, 1.5),
        # below thresholds
        (i("did_error"), i("did_view"), i("did_click"), 0, 10, 4, 0.09, 0.5),
        (i("did_error"), i("did_view"), i("did_signup"), 1, 10, 400, 0.5, 0.0025),
        # two atoms, rendered without ^
        (i("customerIn"), i("homeOf"), None, 3, 10, 4, 0.3, 0.75),
    ]
    scored = spark.createDataFrame(rows, "head string, body1 string, body2 string, support bigint, "
                                         "body_size bigint, head_size bigint, conf double, "
                                         "head_coverage double")
    out = sorted((r.head, r.body1, r.body2, r.rule) for r in to_rules(scored, schema).collect())
    assert out == sorted([
        (i("did_view"), i("did_purchase"), i("did_click"),
         "did_view(User,Hour) <= did_purchase(User,Hour) ^ did_click(User,Hour) 0.5 1.25"),
        (i("did_click"), i("did_view"), i("did_error"),
         "did_click(User,Hour) <= did_view(User,Hour) ^ did_error(User,Hour) 0.5 1.25"),
        (i("did_click"), i("did_view"), i("did_error"),
         "did_click(User,Hour) <= did_view(User,Hour) ^ did_error(User,Hour) 0.6 1.5"),
        (i("customerIn"), i("homeOf"), None,
         "customerIn(Customer,Nation) <= homeOf(Nation,Customer) 0.3 0.75"),
    ])
