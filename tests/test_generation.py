"""Whole runs over small raw files, traced by hand; every kind of output; modes of a run."""

import json
import tarfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnwise.functions.order import ordinals, row_ordinals, running
from turnwise.operators import vocab as V
from turnwise.plans import modes as M
from turnwise.plans import problems as P
from turnwise.plans.config import SWEEP, Config
from turnwise.sinks import outputs as O
from turnwise.sources import archives as A
from turnwise.sources import readers as R

MOVIE_LINES = """L1 +++$+++ u0 +++$+++ m0 +++$+++ ANN +++$+++ Hello there.
L2 +++$+++ u1 +++$+++ m0 +++$+++ BO LEE +++$+++ I don't know!
L3 +++$+++ u0 +++$+++ m0 +++$+++ ANN +++$+++ It's fine, really?
"""
MOVIE_DIALOGS = "u0 +++$+++ u1 +++$+++ m0 +++$+++ ['L1', 'L2', 'L3']\nu0 +++$+++ u1 +++$+++ m0 +++$+++ ['L1', 'L2', 'L1']\nu0 +++$+++ u1 +++$+++ m0 +++$+++ ['L1', 'L1045']\n"
DAILY = "Hi there . __eou__ I'm ok! __eou__ Bye __eou__\nHi __eou__ no marker at end\n"
PERSONA = ("1 hello how are you?\tfine thanks.\n2 what's up\tnot much!\n1 __SILENCE__\thi\n2 bye\tbye now\n", "1 good day\tgood day to you\n")
SUBTITLES = '<s id="1">\n<w id="1.1">Hello</w>\n<w id="1.2">there</w>\n<s id="2">\n<w id="2.1">Yes</w>\n<s id="3">\n<w id="3.1">Fine</w>\n'


def files(folder, **texts):
    for name, text in texts.items():
        p = Path(folder, name.replace("__", "/").replace("_dot_", "."))
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def put(folder, texts):
    for name, text in texts.items():
        p = Path(folder, name)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(folder)


def spaced(text):
    return " ".join(text.split())


def pairs_of(spark, made):
    return [(r.split, spaced(r.source), spaced(r.target)) for r in spark.read.parquet(made.pairs).orderBy("ordinal").collect()]


def tokens_of(spark, made):
    return [r.token for r in O.read_vocabulary(spark, made.vocabulary).orderBy("id").collect()]


CORNELL = {"movie_lines.txt": MOVIE_LINES, "movie_conversations.txt": MOVIE_DIALOGS}


def test_movies(spark, tmp_path):
    raw = put(tmp_path / "raw", CORNELL)
    made = P.generate(spark, "cornell_chatbot_basic", raw, str(tmp_path / "out"), Config(vocabulary_size=8))
    # the second dialog's first line is its last one's by value; the third's target is no line
    assert pairs_of(spark, made) == [("train", "hello there .", "i do n't know !"), ("train", "i do n't know !", "it 's fine really ?"), ("train", "i do n't know !", "hello there .")]
    assert tokens_of(spark, made) == ["<pad>", "<EOS>", "i", "do", "n't", "know", "!", "<unk>"]
    first = spark.read.parquet(made.encoded).where("split = 'train' and ordinal = 0").first()
    assert (list(first.inputs), list(first.targets)) == ([7, 7, 7, 1], [2, 3, 4, 5, 6, 1])
    lines = {s: [r.value for r in R.lines(spark, f"{made.folder}/train{s}.txt").orderBy("file", "line_no").collect()] for s in ("Source", "Target")}
    assert [spaced(x) for x in lines["Source"]] == [p[1] for p in pairs_of(spark, made)]
    assert [spaced(x) for x in lines["Target"]] == [p[2] for p in pairs_of(spark, made)]
    record = next(p for p in Path(made.folder).iterdir() if p.name.startswith("config."))
    assert json.loads(record.read_text())["rows"] == {"turns": 8, "quarantine": 0, "splits": 3, "routed": 3}


def test_what_is_there_is_not_made_again(spark, tmp_path):
    raw = put(tmp_path / "raw", {"dialogues_text.txt": DAILY})
    made = P.generate(spark, "daily_dialog_chatbot", raw, str(tmp_path / "out"))
    put(tmp_path / "raw", {"dialogues_text.txt": "Other __eou__ words __eou__\n"})
    assert P.generate(spark, "daily_dialog_chatbot", raw, str(tmp_path / "out")) == made
    assert ("train", "hi there .", "i 'm ok !") in pairs_of(spark, made)
    other = P.generate(spark, "daily_dialog_chatbot", raw, str(tmp_path / "out"), Config(vocabulary_size=9))  # other settings, another folder
    assert pairs_of(spark, other) == [("train", "other", "words")]


def test_names(spark, tmp_path):
    raw = put(tmp_path / "raw", CORNELL | {"movie_conversations.txt": MOVIE_DIALOGS.split("\n")[0] + "\n"})
    made = P.generate(spark, "cornell_chatbot_separate_names", raw, str(tmp_path / "out"), Config(vocabulary_size=8, name_vocabulary_size=2))
    assert pairs_of(spark, made) == [("train", "ANN_m0 hello there . <unk_name>", "i do n't know !"), ("train", "<unk_name> i do n't know ! ANN_m0", "it 's fine really ?")]
    assert tokens_of(spark, made) == ["<pad>", "<EOS>", "hello", "there", ".", "i", "do", "<unk>", "ANN_m0", "<unk_name>"]
    assert made.vocabulary.endswith("vocab.chatbot.10")
    strict = P.generate(spark, "cornell_chatbot_separate_names", raw, str(tmp_path / "out"), Config(vocabulary_size=8, name_vocabulary_size=2, strict=True))
    assert len(tokens_of(spark, strict)) == 12  # V + 2N


def test_names_inside_a_line(spark):
    lines = spark.createDataFrame([("L1", "bob", "hi bob and bob bye"), ("L2", "ann", "hi bob"), ("L3", None, "x"), ("L4", "bob", None)], "line_id string, speaker string, clean string")
    from turnwise.operators.dialogs import replaced_names

    got = {r.line_id: (r.speaker, r.clean) for r in replaced_names(lines, spark.createDataFrame([("ann",)], "name string")).collect()}
    assert got == {"L1": ("<unk_name>", "hi <unk_name> and <unk_name> bye"), "L2": ("ann", "hi bob"), "L3": (None, "x"), "L4": ("<unk_name>", None)}


def test_marked_dialogs_take_slots_without_pairs(spark, tmp_path):
    raw = put(tmp_path / "raw", {"dialogues_text.txt": DAILY + "no utterance at all\n" * 78 + "A __eou__ b __eou__\n" * 2})
    made = P.generate(spark, "daily_dialog_chatbot", raw, str(tmp_path / "out"))
    assert pairs_of(spark, made) == [("train", "hi there .", "i 'm ok !"), ("train", "i 'm ok !", "bye"), ("dev", "a", "b"), ("dev", "a", "b")]
    assert tokens_of(spark, made)[2:7] == ["hi", "there", ".", "i", "'m"]


def test_numbered_dialogs_in_two_files(spark, tmp_path):
    names = R.CORPORA["persona"]["files"]
    raw = put(tmp_path / "raw", dict(zip(names, PERSONA, strict=True)))
    three = [("train", "hello how are you ?", "fine thanks ."), ("train", "fine thanks .", "what 's up"), ("train", "what 's up", "not much !")]
    assert pairs_of(spark, P.generate(spark, "persona_chat_chatbot", raw, str(tmp_path / "out"))) == [*three, ("train", "good day", "good day to you")]
    assert pairs_of(spark, P.generate(spark, "persona_chat_chatbot", raw, str(tmp_path / "out"), Config(strict=True))) == three
    assert pairs_of(spark, P.generate(spark, "persona_chat_chatbot", raw, str(tmp_path / "out"), Config(dataset_size=1))) == three[:1]


def test_subtitles(spark, tmp_path):
    raw = put(tmp_path / "raw", {"OpenSubtitles/xml/en/2012/a/1.xml": SUBTITLES, "OpenSubtitles/xml/en/2012/b/2.xml": "<w id=\"1\">no sentence</w>\n"})
    made = P.generate(spark, "opensubtitles_chatbot", raw, str(tmp_path / "out"))
    assert pairs_of(spark, made) == [("train", "hello there", "yes"), ("train", "yes", "fine")]
    strict = P.generate(spark, "opensubtitles_chatbot", raw, str(tmp_path / "out"), Config(strict=True))
    assert pairs_of(spark, strict) == [("train", "", "hello there"), ("train", "hello there", "yes")]


def test_characters(spark, tmp_path):
    raw = put(tmp_path / "raw", {"trainSource.txt": "hé\nb\n", "trainTarget.txt": "x\n\nlonger\n"})
    made = P.generate(spark, "character_chatbot", raw, str(tmp_path / "out"), Config(packed_length=6, shards={"train": 2}))
    rows = {r.ordinal: (list(r.inputs), list(r.targets)) for r in spark.read.parquet(made.encoded).collect()}
    assert rows == {0: ([106, 197, 171, 1], [122, 1]), 1: ([100, 1], [1])} and made.vocabulary is None
    assert spark.read.parquet(f"{made.folder}/packed").count() == 2
    with pytest.raises(FileNotFoundError):
        P.generate(spark, "character_chatbot", str(tmp_path), str(tmp_path / "none"))


def test_problems_are_registered():
    assert sorted(P.PROBLEMS) == ["character_chatbot", "cornell_chatbot_basic", "cornell_chatbot_separate_names", "daily_dialog_chatbot", "opensubtitles_chatbot", "persona_chat_chatbot"]
    with pytest.raises(ValueError, match="daily_dialog_chatbot"):
        P.named("nothing")
    with pytest.raises(ValueError):
        P.register(P.PROBLEMS["daily_dialog_chatbot"])
    d = P.PROBLEMS["character_chatbot"].description(Config(packed_length=9))
    assert d["loss_multiplier"] == 2.0 and d["modality"]["inputs_position"] == "identity" and d["vocab_size"]["targets"] == 258
    assert P.with_changes(Config(), '{"strict": true}').strict
    with pytest.raises(ValueError):
        P.with_changes(Config(), '{"nothing": 1}')


def rows_of(df):
    return sorted((r.file.rpartition("!")[2], r.line_no, r.value) for r in df.collect())


@pytest.mark.parametrize("name", ["x.zip", "x.tar", "x.tar.gz", "x.tgz"])
def test_archives_are_read_where_they_lie(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(A, "TASK", 8)  # members are dealt over tasks
    texts = {"a/one.txt": "x\ny\r\n\nz", "a/b/two.txt": "é\n", "a/empty.txt": "", "skip.me": "no\n"}
    for n, t in texts.items():
        put(tmp_path / "in", {n: ""})
        (tmp_path / "in" / n).write_bytes(t.encode())
    import gzip

    (tmp_path / "in/a/three.txt.gz").write_bytes(gzip.compress(b"q\nr\n"))
    names = [*texts, "a/three.txt.gz"]
    path = str(tmp_path / name)
    if name.endswith("zip"):
        with zipfile.ZipFile(path, "w") as z:
            for n in names:
                z.write(tmp_path / "in" / n, n)
    else:
        with tarfile.open(path, "w" if name.endswith("tar") else "w:gz") as t:
            for n in names:
                t.add(tmp_path / "in" / n, n)
    want = [("a/b/two.txt", 0, "é"), ("a/one.txt", 0, "x"), ("a/one.txt", 1, "y"), ("a/one.txt", 2, ""), ("a/one.txt", 3, "z")]
    assert rows_of(A.archive_lines(spark, path, "*.txt")) == want
    assert rows_of(A.archive_lines(spark, f"file://{path}", "*three*")) == [("a/three.txt.gz", 0, "q"), ("a/three.txt.gz", 1, "r")]


def test_long_members_in_pieces(spark, tmp_path):
    reader = A.ArchiveReader("p.zip", "*")
    import io

    text = "".join(f"{'w' * (i % 50)}{i}\n" for i in range(400_000))
    got = [x for b in reader._lines("m", io.BytesIO(text.encode())) for x in zip(b.column("line_no").to_pylist(), b.column("value").to_pylist(), strict=True)]
    assert got == list(enumerate(text.split("\n")[:-1]))


def test_downloads(tmp_path):
    source = tmp_path / "x.tar.gz"
    source.write_bytes(b"1" * 200_000)
    seen = []
    A.download(source.as_uri(), str(tmp_path / "new/y.tgz"), lambda a, b: seen.append((a, b)))
    assert (tmp_path / "new/y.tgz").read_bytes() == source.read_bytes() and seen[-1][0] == 200_000 and len(seen) > 1
    with pytest.raises(ValueError):
        A.kind_of(str(tmp_path))


def test_problems_read_archives(spark, tmp_path):
    """Nothing is unpacked: the raw folder has the archive alone, as it came or was fetched."""
    put(tmp_path / "in", {"OpenSubtitles/xml/en/2012/a/1.xml": SUBTITLES, "OpenSubtitles/xml/en/2012/b/2.xml": SUBTITLES, "OpenSubtitles/xml/en/2013/c/3.xml": SUBTITLES, "inner/dialogues_text.txt": DAILY})
    (tmp_path / "raw").mkdir()
    with tarfile.open(tmp_path / "raw/en.tar.gz", "w:gz") as t:
        t.add(tmp_path / "in/OpenSubtitles", "OpenSubtitles")
    made = P.generate(spark, "opensubtitles_chatbot", str(tmp_path / "raw"), str(tmp_path / "out"))
    assert pairs_of(spark, made) == [("train", "hello there", "yes"), ("train", "yes", "fine")] * 2
    with zipfile.ZipFile(tmp_path / "far.zip", "w") as z:
        z.write(tmp_path / "in/inner/dialogues_text.txt", "inner/dialogues_text.txt")
    made = P.generate(spark, "daily_dialog_chatbot", str(tmp_path / "raw"), str(tmp_path / "out"), url=(tmp_path / "far.zip").as_uri())
    assert len(pairs_of(spark, made)) == 2
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["en.tar.gz", "ijcnlp_dailydialog.zip"]
    with pytest.raises(FileNotFoundError):
        P.generate(spark, "persona_chat_chatbot", str(tmp_path / "raw"), str(tmp_path / "out"))


def test_modes(spark, tmp_path):
    raw = put(tmp_path / "raw", {"dialogues_text.txt": "".join(f"One {i} __eou__ two {i} __eou__ three {i} __eou__\n" for i in range(100))})
    common = ["--problem", "daily_dialog_chatbot", "--raw_dir", raw, "--data_dir", str(tmp_path / "out"), "--decode_dir", str(tmp_path / "decode"), "--train_dir", str(tmp_path / "train"), "--beam_size", "2"]
    asked = put(tmp_path / "in", {"ask.txt": "hello\n\nbye\n"}) + "/ask.txt"
    made = M.main(["--mode", "generate_data", *common], spark)
    M.main(["--mode", "decode", *common, "--input", asked, "--respond", "draw"], spark)
    lines = [r.value for r in R.lines(spark, f"{tmp_path}/decode/inference.txt").orderBy("file", "line_no").collect()]
    assert len(lines) == 3 and all(len(x.split("\t")) == 2 for x in lines)
    train = {r.target for r in spark.read.parquet(made.pairs).where("split = 'train'").collect()}
    assert all(t in train for x in lines for t in x.split("\t"))
    M.main(["--mode", "decode", *common, "--input", asked, "--output", "beams.txt"], spark)
    beams = [r.value.split("\t") for r in R.lines(spark, f"{tmp_path}/decode/beams.txt", whole=True).orderBy("line_no").collect()]
    assert len(beams) == 3 and all(len(x) == 2 and x[0].split(" ")[0] in ("two", "three") for x in beams)
    sample = M.inputs_of(spark, "dataset", None, spark.read.parquet(made.pairs), 5)
    assert sample.count() == 5 and {r.source for r in sample.collect()} <= {r.source for r in spark.read.parquet(made.pairs).where("split = 'dev'").collect()}
    assert [r.source for r in M.inputs_of(spark, "interactive", None, None, 0, ["a\n", "b\n", "\n", "c\n"]).collect()] == ["a", "b"]
    assert R.arriving_lines(spark, str(tmp_path / "in")).isStreaming
    outs = M.experiment(spark, made, sample, str(tmp_path), str(tmp_path / "sweep"), M.train_responses, beam_size=1, steps=SWEEP[:2])
    assert [Path(o).name for o in outs] == ["test_set_1.txt", "test_set_1328.txt"]
    assert Path(tmp_path, "checkpoint").read_text() == 'model_checkpoint_path: "model.ckpt-1328"'
    record = next(p for p in (tmp_path / "decode").iterdir() if p.name.startswith("config."))
    assert json.loads(record.read_text())["vocabulary_size"] == 16384
    for bad in (["--mode", "fly"], ["--mode", "train", *common], ["--mode", "decode", *common, "--decode_mode", "x"]):
        with pytest.raises((SystemExit, ValueError)):
            M.main(bad, spark)


def test_tools_write_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, "b a"), (1, "a b c"), (2, "a")], "line long, text string")
    best = O.write_top_tokens(V.frequencies(rows, "text", ["line"]), 2, f"{tmp_path}/top")
    assert sorted(tuple(r) for r in best.collect()) == [("a", 3), ("b", 2)]
    assert [r.value for r in spark.read.text(f"{tmp_path}/top").collect()] == ["a", "b"]
    O.write_filtered(rows, "text", ["a", "are n't"], ["line"], f"{tmp_path}/filtered")
    assert [r.value for r in R.lines(spark, f"{tmp_path}/filtered").orderBy("file", "line_no").collect()] == ["b", "b c", ""]


def test_packing(spark):
    rows = spark.createDataFrame([(0, [1, 2], [3]), (0, [4], [5, 6]), (0, [7, 8], [9]), (0, list(range(9)), []), (1, [1], [1])], "shard int, inputs array<int>, targets array<int>").coalesce(1)
    got = [(r.shard, list(r.inputs), list(r.targets), list(r.inputs_segmentation), list(r.targets_position)) for r in V.packed(rows, ["shard"], 4).collect()]
    assert got == [(0, [1, 2, 4], [3, 5, 6], [1, 1, 2], [0, 0, 1]), (0, [7, 8], [9], [1, 1], [0]), (0, list(range(9)), [], [1] * 9, []), (1, [1], [1], [1], [0])]


def test_lines_of_files_in_splits(spark, tmp_path):
    put(tmp_path, {f"{n}.txt": "".join(f"{n}-{i}\n" for i in range(size)) for n, size in (("a", 3), ("b", 500), ("c", 0), ("d", 40))})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = R.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 543 and all(r.value == f"{Path(r.file).stem}-{r.line_no}" for r in got)


def test_orders(spark):
    rows = spark.createDataFrame([(k, k * 10**9 + 7, i) for k in range(50) for i in range(k % 4 + 1)], "g long, far long, i int")
    flat = [r.g for r in rows.orderBy("g", "i").collect()]
    assert {r.far: r.ordinal for r in ordinals(rows, "far").collect()} == {k * 10**9 + 7: k for k in range(50)}
    assert [r.g for r in row_ordinals(rows, "far", "i").orderBy("ordinal").collect()] == flat
    sums = running(spark.range(2000).withColumn("k", F.col("id") % 2), ["k"], "id", F.lit(1), "n", 64)
    assert all(r.n == r.id // 2 + 1 for r in sums.collect())


@pytest.fixture
def many_parts(spark):
    """Sorted outputs have as many part files as there are ranges, however small."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_outputs_of_several_files_are_read_back(spark, tmp_path, many_parts):
    rows = [(("train", "train", "dev", "test")[i % 4], i, i // 3, i % 3, f"source {i}", f"target {i}" if i % 7 else "") for i in range(160)]
    pairs = spark.createDataFrame(rows, "split string, ordinal long, dialog_no long, turn long, source string, target string").repartition(4)
    parts = {Path(path).name: len(list(Path(path).glob("part-*"))) for path in O.export_six(pairs, str(tmp_path))}
    assert parts["trainSource.txt"] > 1 and parts["trainTarget.txt"] > 1
    got = P.given_pairs(spark, str(tmp_path)).orderBy("dialog_no").collect()
    assert sorted((r.split, r.source, r.target) for r in got) == sorted((r[0], r[4], r[5]) for r in rows)
    for split in O.SPLITS:  # in their order
        assert [r.source for r in got if r.split == split] == [r[4] for r in rows if r[0] == split]
    made = P.generate(spark, "character_chatbot", str(tmp_path), str(tmp_path / "out"))
    again = P.generate(spark, "character_chatbot", made.folder, str(tmp_path / "again"))
    assert pairs_of(spark, again) == pairs_of(spark, made) and len(pairs_of(spark, made)) == 160


def test_dialogs_in_several_files(spark, tmp_path, many_parts):
    """Dialogs of different part files stay apart and keep their order."""
    texts = spark.createDataFrame([(i, f"a{i} __eou__ b{i} __eou__") for i in range(60)], "at long, value string")
    texts.repartition(4).orderBy("at").select("value").write.text(f"{tmp_path}/raw/dialogues_text.txt")
    assert len(list(Path(tmp_path, "raw/dialogues_text.txt").glob("part-*"))) == 4
    made = P.generate(spark, "daily_dialog_chatbot", f"{tmp_path}/raw", f"{tmp_path}/out")
    assert [(a, b) for _, a, b in pairs_of(spark, made)] == [(f"a{i}", f"b{i}") for i in range(60)]


def test_part_files_go_by_number(spark):
    names = ["d/part-99999-x.txt", "d/part-100000-x.txt", "d/part-00002-x.txt", "a/other.txt", "b/other.txt"]
    got = spark.createDataFrame([(n,) for n in names], "file string").orderBy(R.file_order(F.col("file"))).collect()
    assert [r.file for r in got] == [names[3], names[4], names[2], names[0], names[1]]


def test_places_run_on_over_batches():
    import pyarrow as pa

    rows = [("a", 0, k) for k in range(5)] + [("a", 64, k) for k in range(3)] + [("b", 0, k) for k in range(4)]
    batches = [pa.record_batch([pa.array([r[0] for r in rows[i : i + 3]]), pa.array([r[1] for r in rows[i : i + 3]])], names=["file", "_start"]) for i in range(0, 12, 3)]
    assert [x for b in R._placed([batches[0], batches[0].slice(0, 0), *batches[1:]]) for x in b.column("_at").to_pylist()] == [r[2] for r in rows]


@pytest.mark.parametrize("cut", ["write_pairs", "export_six", "write_vocabulary", "write_shards", "write_packed", "write_record", "write_mark"])
def test_a_run_cut_at_any_step_is_finished_by_the_next(spark, tmp_path, monkeypatch, cut):
    raw = put(tmp_path / "raw", {"dialogues_text.txt": DAILY})
    config = Config(packed_length=8, vocabulary_size=9)

    def stop(*_, **__):
        raise RuntimeError(cut)

    with monkeypatch.context() as m:
        m.setattr(O, cut, stop)
        with pytest.raises(RuntimeError):
            P.generate(spark, "daily_dialog_chatbot", raw, str(tmp_path / "out"), config)
    made = P.generate(spark, "daily_dialog_chatbot", raw, str(tmp_path / "out"), config)
    assert Path(made.folder, O.FINISHED).exists() and Path(made.folder, "packed/_SUCCESS").exists()
    assert len(pairs_of(spark, made)) == 2


def test_an_output_that_is_gone_is_made_again(spark, tmp_path):
    import shutil

    raw = put(tmp_path / "raw", {"dialogues_text.txt": DAILY})
    made = P.generate(spark, "daily_dialog_chatbot", raw, str(tmp_path / "out"))
    shutil.rmtree(f"{made.folder}/trainTarget.txt")
    P.generate(spark, "daily_dialog_chatbot", raw, str(tmp_path / "out"))
    assert [spaced(r.value) for r in R.lines(spark, f"{made.folder}/trainTarget.txt", whole=True).orderBy("line_no").collect()] == ["i 'm ok !", "bye"]


def plain_packs(rows, length):
    """(shard, inputs, targets, segments of inputs, places in targets) row by row."""
    out, held, key = [], [], None
    for k, a, b in [*rows, (object(), [], [])]:
        if held and (k != key or any(sum(len(h[s]) for h in held) + len((a, b)[s]) > length for s in (0, 1))):
            out.append((key, [x for h in held for x in h[0]], [x for h in held for x in h[1]], [i for i, h in enumerate(held, 1) for _ in h[0]], [p for h in held for p in range(len(h[1]))]))
            held = []
        key = k
        held.append((a, b))
    return out


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_packing_over_batches(spark, batch):
    import random

    rng = random.Random(9)
    rows = [(i // 40, [rng.randint(2, 99) for _ in range(rng.randint(0, 7))], [rng.randint(2, 99) for _ in range(rng.choice([0, 1, 5, 14]))]) for i in range(120)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(batch))
    try:
        got = V.packed(spark.createDataFrame(rows, "shard int, inputs array<int>, targets array<int>").coalesce(1), ["shard"], 12).collect()
    finally:
        spark.conf.unset(name)
    assert [(r.shard, list(r.inputs), list(r.targets), list(r.inputs_segmentation), list(r.targets_position)) for r in got] == plain_packs(rows, 12)
    assert all(len(r.inputs) == len(r.inputs_position) and len(r.targets) == len(r.targets_segmentation) for r in got)


def test_shards_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "SHARD_ROWS", 10)
    coded = spark.createDataFrame([("train", i, [1], [1]) for i in range(35)] + [("dev", i, [1], [1]) for i in range(35, 40)], "split string, ordinal long, inputs array<int>, targets array<int>")
    sizes = {(r.split, r.shard): r["count"] for r in O.write_shards(coded, {}, f"{tmp_path}/a").groupBy("split", "shard").count().collect()}
    assert sizes == {("train", 0): 9, ("train", 1): 9, ("train", 2): 9, ("train", 3): 8, ("dev", 0): 5}
    assert O.write_shards(coded, {"train": 1}, f"{tmp_path}/b").where("split = 'train'").select("shard").distinct().count() == 1


def test_samples_and_shuffles_go_by_hash(spark):
    """The same rows in the same order whatever the partitions: those of least seeded hash, told by the hash itself."""
    rows = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(300)], "a long, b int, t string")
    hashed = rows.select("a", "b", "t", F.xxhash64(F.lit(42), "a", "b").alias("h")).collect()
    want = [r.t for r in sorted(hashed, key=lambda r: (r.h, r.a, r.b))]
    for n in (1, 7):
        assert [r.t for r in V.shuffled(rows.repartition(n), ["a", "b"]).collect()] == want
        assert {r.t for r in R.random_sample(rows.repartition(n), ["a", "b"], 20).collect()} == set(want[:20])
    assert want != [r.t for r in V.shuffled(rows, ["a", "b"], seed=7).collect()]


def test_a_shard_is_more_than_one_task(spark, tmp_path):
    """Before, a shard was sorted by a single task and was one file, however large."""
    from pathlib import Path

    rows = spark.range(4000).selectExpr("'train' AS split", "id AS ordinal", "array(CAST(id AS INT)) AS inputs", "array(1) AS targets")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = O.write_shards(rows, {"train": 1}, f"{tmp_path}/s")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted(Path(tmp_path, "s").rglob("part-*.parquet"))
    assert len(files) > 1 and got.count() == 4000
    # the files, by name, hold the shard's seeded order
    told = [r.ordinal for f in files for r in spark.read.parquet(str(f)).collect()]
    assert told == [r.ordinal for r in rows.orderBy(F.xxhash64(F.lit(42), "ordinal"), "ordinal").collect()]


def test_a_tree_of_files_is_read_into_one_table(spark, tmp_path):
    """Before, every step over the lines opened all files again."""
    for name in ("a/1.xml", "b/2.xml"):
        at = tmp_path / "raw/OpenSubtitles/xml/en/2012" / name
        at.parent.mkdir(parents=True)
        at.write_text("\n".join(f'<s id="{i}">\n<w id="1">{w}</w>' for i, w in enumerate(("hi", "there", name[0]))) + "\n")
    made = P.generate(spark, "opensubtitles_chatbot", str(tmp_path / "raw"), str(tmp_path / "out"), Config(vocabulary_size=10))
    assert spark.read.parquet(f"{made.folder}/lines").count() == 12
    assert sorted((r.dialog_no, r.turn, r.source, r.target) for r in spark.read.parquet(made.pairs).collect()) == [(0, 0, "hi", "there"), (0, 1, "there", "a"), (1, 0, "hi", "there"), (1, 1, "there", "b")]
