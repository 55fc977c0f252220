import json

from quillspark.sources import token_stream as T


def chunk(reply, content=None, **other):
    return "data: " + json.dumps({"id": reply, "choices": [{"index": 0, "delta": {"content": content} if content is not None else {"role": "assistant"}}], **other}, ensure_ascii=False)


def test_lines():
    lines = ["data: [DONE]", ": ping", "", chunk("a"), chunk("a", "Da"), "event: x", chunk("a", ", č\n"), "data:[DONE]", chunk("b", "x"), 'data: {"id": "b", "cho', chunk("b", ""), 'data: {"id": "b", "choices": []}', "data: 5"]
    got = list(T.parsed(x.encode() for x in lines))
    assert got == [(0, None, "done", None), (4, "a", "delta", "Da"), (6, "a", "delta", ", č\n"), (7, "a", "done", None), (8, "b", "delta", "x"), (9, "b", "broken", '{"id": "b", "cho'), (12, "b", "broken", "5")]


def test_batch_and_stream_give_the_texts_back(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    want = {}

    def log(name, replies):
        lines = []
        for reply, text, state in replies:
            lines += [chunk(reply, text[i : i + 3]) + "\n" for i in range(0, len(text), 3)]
            lines.append({"finished": "data: [DONE]", "unfinished": "", "broken": "data: {"}[state])
            want[reply] = (text, state)
        (folder / name).write_text("\n".join(lines))

    def stream():
        query = T.read_stream(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
        return {r["reply"]: (r["answer"], r["state"]) for r in T.replies(spark.read.schema(T.DELTA).parquet(str(tmp_path / "out"))).collect()}

    log("a.sse", [("1", "Prvi odgovor, dolg in z znaki č.", "finished"), ("2", "pol", "unfinished"), ("3", "zlomljen", "broken")])
    assert stream() == want
    log("b.sse", [("4", "še eden", "finished")])
    (folder / "_c.sse").write_text(chunk("9", "hidden"))
    assert stream() == want  # only what is new is read
    assert {r["reply"]: (r["answer"], r["state"]) for r in T.replies(T.read(spark, str(folder))).collect()} == want
    empty = tmp_path / "none"
    empty.mkdir()
    assert T.read(spark, str(empty)).count() == 0
