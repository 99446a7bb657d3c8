"""Items that share an id, or have none."""

from test_operators import frame, prose

from scanspark.llm import decontaminate


def test_every_text_of_an_id_and_without_one_is_an_item(spark):
    texts = [prose(30, 8000 + i) for i in range(5)]
    items = frame(spark, [(0, texts[0]), (0, texts[1]), (0, texts[1]), (None, texts[2]), (None, texts[3]), (1, texts[4]), (None, None), (2, None)], "item_id long, text string")
    docs = frame(spark, [(i, f"{prose(50, 8100 + i)} {t} {prose(50, 8200 + i)}") for i, t in enumerate(texts)] + [(9, prose(80, 8300))])
    got = decontaminate.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == {(0, 0, 1.0), (1, 0, 1.0), (2, None, 1.0), (3, None, 1.0), (4, 1, 1.0)} and len(got) == 5
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()] == [9]
