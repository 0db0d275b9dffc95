from __future__ import annotations

from laminar.llm.private_data import find_private_data


def test_terms_far_from_the_mention_and_in_texts_without_one(spark):
    far = " common words of every kind" * 8
    rows = [(k, f"common words of every kind number {'abcdefghij'[k % 10]}") for k in range(200)]
    rows += [(300 + k, f"Zanzibarov and Liu and \u738b\u4f1f{far} {w} zan@corp.org") for k, w in enumerate(("early", "later", "often", "never", "again"))]
    rows += [(400, "Here zanzibarov stands alone, Liu too: LIU, \u738b\u4f1f."), (401, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in find_private_data(docs).collect():
        text = dict(rows)[r["doc_id"]]
        found = [text[s["start"] : s["end"]] for s in r["added"]]
        if r["doc_id"] in range(200) or text is None:
            assert not found
        else:
            assert "common" not in found and "zan" not in found
            wanted = ["zanzibarov", "Liu", "LIU", "\u738b\u4f1f"] if r["doc_id"] == 400 else ["Zanzibarov", "Liu", "\u738b\u4f1f"]
            assert [f for f in found if f in wanted] == wanted
