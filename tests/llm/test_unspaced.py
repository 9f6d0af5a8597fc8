import pyarrow as pa
import pytest

from sigframe.llm import decontaminate


def texts_of(words):
    return [bytes(words.body[a:b]).decode() for a, b in zip(words.starts, words.ends)]


def test_letters_of_unspaced_scripts_are_words():
    found = decontaminate.plain_words(pa.array(["北京，ABC コーヒー。l’été «où»　x", None, "a-b"]))
    assert texts_of(found) == ["北", "京", "abc", "コ", "ー", "ヒ", "ー", "l", "été", "où", "x", "a", "b"]
    assert found.offsets.tolist() == [0, 11, 11, 13]


@pytest.mark.parametrize("item, before, after", [
    ("中国的首都是哪一座城市", "我们知道", "这个问题很简单"),
    ("日本で一番高い山は何ですか", "次の質問", "と聞かれた"),
    ("เมืองหลวงของประเทศไทยคืออะไร", "คำถามคือ", "ตอบได้ง่าย"),
])
def test_a_copy_inside_a_longer_sentence_is_found(frame, item, before, after):
    docs = frame([(1, before + item + after), (2, before + after)], "doc_id long, text string")
    rows = decontaminate.find_leaks(docs, frame([(7, item)], "item_id long, text string")).collect()
    # Thai signs above and below letters are letters of the script too.
    assert [(r["doc_id"], r["item_id"], r["start"], r["n_words"], r["distance"]) for r in rows] == [
        (1, 7, len(before), len(item), 0)
    ]
