"""Structured chunkers on texts of our own in the same grammar."""

import pytest

from lexmill.operators import structured


def found(spark, chunker, text):
    docs = spark.createDataFrame([(1, text, "Закон")], "doc_id long, text string, prefix string")
    return structured.blocks(docs, chunker).orderBy("pos").collect()


def test_federal_law(spark):
    text = "О чём закон\n§ 2. Общее\nСтатья 45. Обеспечение\n(введена законом)\n1. Первая часть.\nпродолжение\n2. Вторая часть.\nСтатья 46. Утратила силу\nСтатья 47\nСтатья 47.1. Без частей\nПросто текст."
    rows = found(spark, "federal_law", text)
    assert [r["anchor"] for r in rows] == ["preamble", "art.45/part.1", "art.45/part.2", "art.46", "art.47.1"]
    assert rows[1]["lines"] == ["(введена законом)", "1. Первая часть.", "продолжение"] and rows[1]["section"] == "§ 2. Общее"
    assert rows[1]["citation"] == "Закон, ст. 45, ч. 1" and rows[1]["label"] == "Статья 45. Обеспечение — ч. 1"
    assert rows[3]["lines"] == ["Статья 47"] and rows[3]["label"] == "Статья 46. Утратила силу"


def test_civil_code(spark):
    long = "\n".join(f"{n}. " + "Слово текста статьи. " * 25 for n in (1, 2, 3))
    rows = found(spark, "civil_code", f"Статья 1. Короткая\n1. Раз.\n2. Два.\nСтатья 2. Длинная\n{long}")
    assert [r["anchor"] for r in rows] == ["art.1", "art.2/point.1", "art.2/point.2", "art.2/point.3"]


def test_court_review(spark):
    rows = found(spark, "court_review", "Обзор практики\nРАЗДЕЛ ПЕРВЫЙ\nПозиция 1\nТезис один. Подробности.\nПозиция 2\nТезис два.")
    assert [(r["anchor"], r["section"], r["position"]) for r in rows] == [("preamble", "вводная часть", None), ("pos.1", "РАЗДЕЛ ПЕРВЫЙ", 1), ("pos.2", "РАЗДЕЛ ПЕРВЫЙ", 2)]
    assert rows[1]["label"] == "Позиция 1. Тезис один."
    rows = found(spark, "court_review", "25. Первая позиция.\nтекст\n3. Это не позиция.\n30. Вторая позиция.")
    assert [r["position"] for r in rows] == [25, 30] and len(rows[0]["lines"]) == 3


def test_government_resolution(spark):
    text = (
        "Правительство постановляет:\n1. Утвердить положение.\n2. Вступает в силу.\n\nУТВЕРЖДЕНО\nпостановлением Правительства\nот 1 мая N 10\n\nПОЛОЖЕНИЕ\nо гарантиях\n\nI. Общие\nположения\n\n1. Пункт один.\n2. Пункт два.\n\n"
        "II. Порядок\n\n3. Пункт три.\n\nПриложение N 1\nк Положению\n\nФОРМА ТРЕБОВАНИЯ\nоб уплате\n1. Строка формы.\nУполномоченное лицо\nподпись"
    )
    rows = found(spark, "government_resolution", text)
    assert [r["anchor"] for r in rows] == [
        "resolution/p.1", "resolution/p.2", "regulation/p.1", "regulation/p.2", "regulation/p.3", "payment_demand_form/app.1/head", "payment_demand_form/app.1/p.1", "payment_demand_form/app.1/tail",
    ]
    assert rows[2]["lines"] == ["ПОЛОЖЕНИЕ", "о гарантиях", "1. Пункт один."] and rows[2]["section"] == "I. Общие положения" and rows[4]["section"] == "II. Порядок"
    assert rows[5]["form"] == "payment_demand_form" and rows[5]["appendix"] == 1


def test_unknown(spark):
    with pytest.raises(ValueError, match="unknown chunker"):
        structured.blocks(spark.createDataFrame([], "doc_id long, text string, prefix string"), "nope")


def test_items_are_grouped(spark):
    text = "Статья 1. Перечень\n1. Условия таковы:\n" + "\n".join(f"{n}) " + "условие договора " * 16 for n in range(1, 8))
    docs = spark.createDataFrame([(1, text, "Закон")], "doc_id long, text string, prefix string")
    rows = structured.cut_blocks(structured.federal_law(docs)).orderBy("chunk_index").collect()
    assert len(rows) > 2 and all(r["body"].startswith("1. Условия таковы:") and len(r["body"]) <= 1200 for r in rows)
    assert rows[0]["item"] == "1–2" and rows[0]["chunk_count"] == len(rows) and rows[0]["article"] == "1"


def test_sub_items(spark):
    letters = "\n".join(f"{x}) " + "длинное условие " * 28 for x in "абв")
    text = f"Статья 9. Требования\n1. Состав:\n1) короткий пункт;\n2) длинный пункт:\n{letters}\n3) ещё один."
    docs = spark.createDataFrame([(1, text, "Закон", "Закон N 9", "law")], "doc_id long, text string, prefix string, source_display string, source_kind string")
    rows = structured.chunks(docs, "federal_law").orderBy("chunk_index").collect()
    assert [(r["item"], r["subitem"]) for r in rows] == [("1", None), ("2", "а"), ("2", "б"), ("2", "в"), ("3", None)]
    assert rows[1]["anchor"] == "art.9/part.1/item.2/sub.а" and rows[1]["citation"] == "Закон, ст. 9, ч. 1, п. 2, пп. а"
    assert rows[0]["text"].startswith("[Источник: Закон N 9 | закон РФ]\n[Фрагмент: Статья 9. Требования — ч. 1, п. 1]\n\n1. Состав:\n1) короткий")
    words = sorted(text.split("\n", 1)[1].split())
    assert set(words) <= {w for r in rows for w in r["body"].split()}


def test_plain_blocks_keep_titles_and_heads(spark):
    lines = ["ОБЗОР", "ПРАКТИКИ", "Предложение обзора. " * 80]
    units = spark.createDataFrame([(1, "preamble", lines)], "doc_id long, anchor string, lines array<string>")
    rows = structured.cut_blocks(units, items=False).orderBy("chunk_index").collect()
    assert len(rows) > 1 and rows[0]["body"].startswith("ОБЗОР\nПРАКТИКИ\nПредложение") and max(len(r["body"]) for r in rows) <= 1200


def test_unstructured(spark):
    docs = spark.createDataFrame([(1, "Просто текст.", "З"), (2, "Статья 1. Есть\nТекст.", "З")], "doc_id long, text string, prefix string")
    assert [r["doc_id"] for r in structured.unstructured(docs, "federal_law").collect()] == [1]
