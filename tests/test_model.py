import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marginalia.operators import model
from marginalia.spec import Instruction

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def parts_of(user):
    """Content and instruction of a prompt."""
    found = re.search(r"Markdown:\n\n(`+)\n(.*)\n\1\n\nInstructions:\n\n\1\n(.*)\n\1\n\nResult", user, re.S)
    return found.group(2), found.group(3)


def echo_model():
    def ask(system, user):
        content, instruction = parts_of(user)
        if instruction == "fail":
            return model.Reply("partly", 3, "broke")
        if instruction == "raise":
            raise RuntimeError("no line")
        return f"[{instruction}:{content}]"

    return ask


def test_chain_folds_in_order(spark):
    got = model.instruction_chain(items(spark, "x", "a ```` b"), "text", ["one", "two"], echo_model)
    assert [r["out"] for r in got.orderBy("id").collect()] == ["[two:[one:x]]", "[two:[one:a ```` b]]"]


def test_no_instructions_leave_the_text(spark):
    assert model.instruction_chain(items(spark, "x"), "text", [], echo_model).first()["out"] == "x"


def test_failures_become_output(spark):
    failed = "partly\n\n## Error Applying Instructions\n\nEXIT CODE: 3\n\nSTDERR: broke"
    raised = "\n\n## Error Applying Instructions\n\nEXIT CODE: 0\n\nERROR: no line\n\nSTDERR: "
    frame = items(spark, "x")
    assert model.instruction_chain(frame, "text", ["fail"], echo_model).first()["out"] == failed
    assert model.instruction_chain(frame, "text", ["raise"], echo_model).first()["out"] == raised
    assert model.instruction_chain(frame, "text", ["fail", "on"], echo_model).first()["out"] == f"[on:{failed}]"
    native = frame.select(
        model.error_section(F.lit("partly"), F.lit(3), F.lit(None).cast("string"), F.lit("broke")),
        model.error_section(F.lit(None).cast("string"), F.lit(0), F.lit("no line"), F.lit(None).cast("string")),
        model.error_section(F.lit("fine"), F.lit(0), F.lit(None).cast("string"), F.lit("")),
    ).first()
    assert tuple(native) == (failed, raised, "fine")


def test_one_retry():
    calls = []

    def ask(system, user):
        calls.append(user)
        return model.Reply("late", 0) if len(calls) > 1 else model.Reply("", 1)

    assert model._ask(ask, "prompt", 1) == "late" and len(calls) == 2
    calls.clear()
    assert "EXIT CODE: 1" in model._ask(ask, "prompt", 0) and len(calls) == 1


def test_python_and_column_prompts_agree(spark):
    texts = ["plain", "a ``` b", "`````", "{instructions} {backticks}"]
    frame = items(spark, *texts)
    got = [r[0] for r in frame.orderBy("id").select(model.prompt_render(F.col("text"), F.lit("do {content}"))).collect()]
    assert got == [model._user_prompt(text, "do {content}", model._ticks(text)) for text in texts]


def test_report_of_any_size(spark):
    rows = [("small", 1, "b"), ("small", 0, "a"), *(("large", i, f"line {i} ````") for i in range(200))]
    frame = spark.createDataFrame(rows, "report string, ord long, out string").repartition(5)
    got = {r["report"]: r["out"] for r in model.report_instruction(frame, "report", ["sum"], echo_model).collect()}
    assert got["small"] == "[sum:a\nb]"
    assert got["large"] == "[sum:" + "\n".join(f"line {i} ````" for i in range(200)) + "]"


def test_calls_are_spread_over_tasks(spark):
    def place_model():
        from pyspark import TaskContext

        return lambda system, user: str(TaskContext.get().partitionId())

    rows = spark.range(0, 1000, 1, 1).select("id", F.col("id").cast("string").alias("text"))
    done = model.instruction_chain(rows, "text", ["go"], place_model, parallelism=12)
    assert done.select("out").distinct().count() == 12
    some = F.when(F.col("id") % 2 == 0, F.array(F.lit("go"))).otherwise(F.expr("cast(array() as array<string>)"))
    got = {r["id"]: r["out"] for r in model.apply_instructions(rows, "text", some, place_model, parallelism=8).collect()}
    assert len(got) == 1000 and all(got[i] == str(i) for i in range(1, 1000, 2))
    assert len({got[i] for i in range(0, 1000, 2)}) == 8


@pytest.mark.parametrize(
    "path, want", [("a.json", ["all", "j"]), ("json", ["all", "j"]), ("x.cjson", ["all"]), ("a.b.json", ["all", "j", "bj"])]
)
def test_file_criteria(spark, path, want):
    rules = [Instruction("all"), Instruction("j", "json"), Instruction("bj", "b.json")]
    matching = model.instructions_for_file(F.lit(path), rules)
    got = spark.range(1).select(F.inline(matching)).orderBy("ord").collect()
    assert [r["instruction"] for r in got] == want


def test_page_criteria(spark):
    rules = [Instruction("a", "Example.org"), Instruction("b", "http://plain")]
    both = lambda url, **o: [r["instruction"] for r in spark.range(1).select(F.inline(model.instructions_for_page(F.lit(url), rules, **o))).collect()]
    assert both("http://www.example.org/x") == [] and both("http://www.example.org/x", lower=True) == ["a"]
    assert both("http://example.org", lower=True) == [] and both("http://plain") == ["b"]


def test_history_of_calls(spark, tmp_path):
    from marginalia.operators.sinks import save_history

    done = model.instruction_chain(items(spark, "x", "y"), "text", ["one", "two"], echo_model, history="said")
    rows = model.chat_messages(done, "id", "said").orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["role"]) for r in rows[:3]] == [("0/0", "system"), ("0/0", "user"), ("0/0", "assistant")]
    assert [r["text"] for r in rows if r["role"] == "assistant"] == ["[one:x]", "[two:[one:x]]", "[one:y]", "[two:[one:y]]"]
    assert parts_of(rows[4]["text"]) == ("[one:x]", "two")
    save_history(model.chat_messages(done, "id", "said"), str(tmp_path), "1")
    assert spark.read.json(str(tmp_path / "chat-history-1.jsonl")).count() == 12


def brute_fold(rows, ask, limit):
    """Answers of one report, level by level, with plain loops over stretches of its text."""
    step, level = limit // 2, [text for _, text in sorted(rows)]
    cut = (step - 1) // 4
    while True:
        pieces, before = {}, 0
        for text in level:
            for at in range(0, max(1, len(text)), cut):
                lead = "" if at else "\n"
                pieces.setdefault(before // step, []).append(lead + text[at : at + cut])
                before += len((lead + text[at : at + cut]).encode())
        firsts, place = {}, 0
        for text in level:  # whether a piece begins with an item
            for at in range(0, max(1, len(text)), cut):
                size = len(text[at : at + cut].encode()) + (not at)
                firsts.setdefault(place // step, not at)
                place += size
        joined = ["".join(pieces[k])[1 if firsts[k] else 0 :] for k in sorted(pieces)]
        assert all(len(text.encode()) <= limit for text in joined)
        level = [ask(text) for text in joined]
        if len(level) == 1:
            return level[0]


def short_model():
    from hashlib import md5

    return lambda system, user: md5(user.encode()).hexdigest()


def test_folded_reports_equal_a_loop(spark):
    rows = [("a", i, f"line {i} of ünit\n") for i in range(90)] + [("b", 0, "ß" * 700), ("b", 1, "\n\nend"), ("b", 2, "")]
    rows += [("one", 5, "x"), (None, 1, "no key")]
    frame = spark.createDataFrame(rows, "report string, ord long, out string").repartition(7)
    answers, said = model.fold_instruction(frame, ["report"], "sum", short_model, limit=200)
    got = {r["report"]: r["out"] for r in answers.collect()}
    ask = lambda text: short_model()("", model._user_prompt(text, "sum", model._ticks(text)))
    assert got == {key: brute_fold([r[1:] for r in rows if r[0] == key], ask, 200) for key in ("a", "b", "one", None)}
    assert said.groupBy("report").agg(F.max("level")).filter("report = 'a'").first()[1] >= 2
    assert said.agg(F.max(F.length("user"))).first()[0] < 200 + len(model.USER_PROMPT) + 100
    two = {r["report"]: r["out"] for r in model.report_instruction(frame, "report", ["sum", "again"], short_model, limit=200).collect()}
    again = lambda text: short_model()("", model._user_prompt(text, "again", 3))
    assert two["a"] == again(got["a"])


def test_answers_that_do_not_get_shorter_are_an_error(spark):
    frame = spark.createDataFrame([("a", i, "x" * 30) for i in range(20)], "report string, ord long, out string")
    with pytest.raises(ValueError, match="as long as what they answer"):
        model.fold_instruction(frame, ["report"], "sum", lambda: lambda system, user: user, limit=100)


def test_copies_are_spread_over_tasks(spark):
    def place_model():
        from pyspark import TaskContext

        return lambda system, user: str(TaskContext.get().partitionId())

    rows = spark.range(2050).select(F.when(F.col("id") < 2000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    done = model.instruction_chain(rows, "text", ["go"], place_model, parallelism=8)
    assert done.groupBy("out").count().agg(F.max("count")).first()[0] < 2 * 2050 / 8


def test_each_command_has_its_own_instructions(spark):
    from marginalia.plans.report import Command, chained_report, chat_history

    frame = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "ord long, out string")
    report = chained_report([Command(frame("a", "b"), ("sum",)), frame("plain"), Command(frame("c"), ("sum", "cut"))], echo_model)
    assert {r["cmd"]: r["text"] for r in report.pieces.collect()} == {0: "[sum:a\nb]", 1: "plain", 2: "[cut:[sum:c]]"}
    said = chat_history(report.exchanges).filter("role = 'assistant'").orderBy("conv_id").collect()
    assert [r["text"] for r in said] == ["[sum:a\nb]", "[sum:c]", "[cut:[sum:c]]"]
    assert chained_report([frame("x")]).exchanges is None
