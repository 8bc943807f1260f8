"""Transcripts, intervals and segments."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from nodewell.functions import scalars, speechtext, telemetry
from nodewell.operators import speech
from nodewell.sources import logs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_distance_equals_the_plain_table(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
    assert speechtext.edit_distance(a, b) == d[-1][-1]


def test_error_rate_is_of_the_corpus(spark):
    rows = [("a b c d", "a x c"), ("a", "b c d"), ("", "x"), (None, None), ("same  words", "same words")]
    e = speech.utterance_errors(spark.createDataFrame(rows, "reference string, hypothesis string"))
    got = [(r.edits, r.words, r.accuracy) for r in e.collect()]
    assert got == [(2, 4, 50.0), (3, 1, 0.0), (1, 0, 0.0), (0, 0, 0.0), (0, 2, 100.0)]
    assert speech.word_error_rate(e).first().wer == pytest.approx(6 / 7)


def english(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(speechtext.normalize_text_english(F.col("t"), {"colour": "color"})).collect()]


def test_english_normaliser(spark):
    cases = {
        "Uh, Mr. Smith won't [noise] go (laughs)!": "mister smith will not go",
        "twenty five": "25",
        "two thousand three hundred and five": "2305",
        "nineteen sixty": "1960",
        "one oh one": "101",
        "the twenty first": "the 21st",
        "the sixties and 1960s": "the 60s and 1960s",
        "twenty million dollars": "$20000000",
        "two dollars and seven cents": "$2.07",
        "fifty percent": "50%",
        "three per cent": "3%",
        "minus five": "-5",
        "three point one four": "3.14",
        "double five one": "551",
        "two and a half": "2.5",
        "one": "one",
        "1,000 colour": "1000 color",
        "and then": "and then",
        "a hundredth": "a 100th",
        "naïve Œuvre": "naive oeuvre",
        "it's he'd been there": "it is he had been there",
    }
    got = dict(zip(cases, english(spark, *cases)))
    assert {k: v.strip() for k, v in got.items()} == cases
    assert english(spark, None, "") == [None, ""]


def test_basic_normaliser(spark):
    f = lambda t, **o: spark.createDataFrame([(t,)], "t string").select(speechtext.normalize_text_basic(F.col("t"), **o)).first()[0]
    assert f("Hello,  <b>Wörld</b> (aside) [x]!") == "hello wörld "
    assert f("Wörld ßø", remove_diacritics=True) == "world sso" and f("ab", split_letters=True) == "a b"


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(scalars.format_timestamp(lit(360000 + 6000 + 105))) == "01:01:01.050" and one(scalars.format_timestamp(lit(5), True)) == "00:00:00,050"
    assert one(scalars.format_lrc(lit(6123))) == "01:01.23"
    assert [one(scalars.confidence_band(lit(p))) for p in (0.329, 0.33, 0.66)] == ["low", "medium", "high"]
    assert [one(scalars.confidence_colour(lit(p), 10)) for p in (0.0, 0.9, 1.0)] == [0, 7, 9]
    assert one(scalars.string_similarity(lit("abc"), lit("abd"))) == pytest.approx(2 / 3) and one(scalars.string_similarity(lit(""), lit(""))) == 1.0
    assert one(scalars.best_command(lit("Turn left"), ["turn right", "turn left"])["command"]) == "turn left"
    assert one(scalars.clip_score(lit(-0.5))) == 0.0 and one(scalars.tokens_per_second(lit(10), lit(3.0))) == 3.333 and one(scalars.tokens_per_second(lit(10), lit(0.0))) is None
    t = one(telemetry.parse_speech_timings(lit("load time = 5.5 ms\nencode time = 10 ms / 3 runs\ntotal time = 7 ms\n total time =  9.25 ms")))
    assert (t.load_ms, t.encode_ms, t.decode_ms, t.total_ms) == (5.5, 3.33, None, 9.25)
    p = one(scalars.parse_movement_payload(lit("2024-01-01,10:00,Left,1,,x,2.5,3,4,5,6")))
    assert (p.x_start, p.x_end, p.CPU_usage, p.GPU_usage, p.mem_usage, p.CPU_temp, p.GPU_temp) == (1.0, 0.0, 0.0, 2.5, 3.0, 5.0, 6.0)


def test_sequence_quality(spark):
    import math

    rows = [(1, 1, i, i % 2 if i >= 8 else 7, -0.5) for i in range(40)]
    q = speech.sequence_quality(spark.createDataFrame(rows, "audio_id int, seg_no int, tok_no int, id int, plog double")).first()
    assert q.sum_logprobs == -20.0 and q.score == -0.5 and q.entropy == pytest.approx(math.log(2)) and q.failed
    flags = "audio_id int, seg_no int, tok_no int, id int, plog double, ns double"
    told = lambda plog, ns, n=8: speech.sequence_quality(spark.createDataFrame([(1, 1, i, i, plog, ns) for i in range(n)], flags), "ns").first()
    assert (told(-1.5, 0.1).no_speech, told(-1.5, 0.1).fallback) == (False, True) and (told(-1.5, 0.9).no_speech, told(-1.5, 0.9).fallback) == (True, False)
    assert not told(-0.5, 0.1).fallback
    penal = speech.sequence_quality(spark.createDataFrame(rows[:32], "audio_id int, seg_no int, tok_no int, id int, plog double"), length_penalty=1.0).first()
    assert penal.score == pytest.approx(-16 / (37 / 6)) and not penal.failed


def test_energies(spark):
    x = spark.createDataFrame([(1, i, 1.0 if i < 30 else 0.1) for i in range(40)], "audio_id int, i long, value double")
    g = speech.speech_energy_gate(x, last_ms=5, rate=2000).first()
    assert g.energy_last == pytest.approx(0.1) and g.silent_tail
    assert not speech.speech_energy_gate(x, last_ms=20, rate=2000).first().silent_tail
    filtered = [r.value for r in speech.high_pass(x, 100.0, 2000).orderBy("i").collect()]
    a = 1 / 2000 / (1 / (2 * 3.141592653589793 * 100) + 1 / 2000)
    assert filtered[:3] == [1.0, pytest.approx(a), pytest.approx(a * a)]
    textbook = [r.value for r in speech.high_pass(x, 100.0, 2000, textbook=True).orderBy("i").collect()]
    assert textbook[1] == pytest.approx(1 - a) and abs(textbook[29]) < 0.01
    s = spark.createDataFrame([(1, i, 0.0 if i < 50 else 2.0, 1.0) for i in range(100)], "audio_id int, i long, left double, right double")
    seg = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 10), (1, 2, 3, 8), (2, 0, 0, 5)], "audio_id int, seg_no int, t0 long, t1 long")
    got = {(r.audio_id, r.seg_no): (r.energy0, r.energy1, r.speaker) for r in speech.segment_energy(seg, s, rate=1000).collect()}
    assert got[1, 0] == (0.0, 50.0, "1") and got[1, 1] == (100.0, 50.0, "0") and got[1, 2] == (60.0, 50.0, "0") and got[2, 0][2] == "?"


def test_time_map(spark):
    m = spark.createDataFrame([(1, 0, 100), (1, 10, 200), (1, 20, 205)], "audio_id int, processed_time long, original_time long")
    t = spark.createDataFrame([(1, x) for x in (-5, 0, 3, 10, 17, 99)] + [(2, 7)], "audio_id int, t long")
    assert {(r.audio_id, r.t): r.original_time for r in speech.map_time(t, m).collect()} == {(1, -5): 100, (1, 0): 100, (1, 3): 130, (1, 10): 200, (1, 17): 203, (1, 99): 205, (2, 7): 7}


def test_chunks_and_wrapping(spark):
    c = spark.createDataFrame([(1, 0, 0, 0, 120), (1, 1, 0, 0, 50), (1, 1, 1, 50, 80)], "audio_id int, chunk int, seg_no int, t0 long, t1 long")
    assert [(r.t0, r.t1) for r in speech.merge_chunks(c, 16000).orderBy("chunk", "seg_no").collect()] == [(0, 120), (120, 150), (150, 180)]
    tokens = [(" ab", 0, 1), ("cd", 1, 2), (" efg", 2, 3), (" h", 3, 4)]
    s = spark.createDataFrame([(1, 0, 9, tokens)], "audio_id int, t0 long, t1 long, tokens array<struct<text: string, t0: long, t1: long>>")
    wrap = lambda n, w: [(r.part, r.t0, r.t1, r.text) for r in speech.wrap_segments(s, n, w).collect()]
    assert wrap(6, True) == [(0, 0, 2, " abcd"), (1, 2, 9, " efg h")]
    assert wrap(4, False) == [(0, 0, 1, " ab"), (1, 1, 2, "cd"), (2, 2, 3, " efg"), (3, 3, 9, " h")]
    assert wrap(99, True) == [(0, 0, 9, " abcd efg h")]


def vad(spark, probs, **o):
    df = spark.createDataFrame([("x", i, p) for i, p in enumerate(probs)], "audio_id string, i int, prob double").repartition(3)
    return [(r.t0, r.t1) for r in speech.speech_segments(df, **o).orderBy("seg_no").collect()]


def test_speech_segments_by_hand(spark):
    w = dict(window=1600, pad_ms=0)  # a window is a tenth of a second
    assert vad(spark, [0.1] * 5 + [0.9] * 5 + [0.1] * 10, **w) == [(50, 100)]
    assert vad(spark, [0.9] * 2 + [0.1] * 10, **w) == []  # too short
    assert vad(spark, [0.1] * 5 + [0.9] * 5, **w) == [(50, 100)]  # still on at the end
    assert vad(spark, [0.9] * 5 + [0.4] * 5 + [0.9] * 5 + [0.1] * 5, **w) == [(0, 150)]  # between both limits speech goes on
    assert vad(spark, [0.9] * 5 + [0.1] * 2 + [0.9] * 5 + [0.1] * 9, **w) == [(0, 50), (70, 120)]
    assert vad(spark, [0.1] * 5 + [0.9] * 5 + [0.1] * 9, window=1600, pad_ms=30) == [(47, 103)]
    cut = vad(spark, [0.9] * 40 + [0.1] * 9, max_speech_s=2, **w)
    assert len(cut) == 1  # cut on the spot, and joined again as no gap is left


def stretches(kinds, min_speech=4000, min_silence=1600, limit=float("inf"), joined=True):
    """Of a text of one sign per window of 1600: # on, - on hold, . off; joined: as few runs as there can be."""
    state, out, i = speech.Stretches(1600, min_speech, min_silence, limit), [], 0
    while i < len(kinds):
        n = len(kinds[i:]) - len(kinds[i:].lstrip(kinds[i])) if joined else 1
        out += state.run(".-#".index(kinds[i]), i, i + n - 1)
        i += n
    return [(a // 1600, b // 1600) for a, b in [*out, *state.end(1600 * len(kinds))]]


@settings(max_examples=200, deadline=None)
@given(st.text(".-#", max_size=80), st.sampled_from([float("inf"), 5_000, 30_000]), st.sampled_from([0, 1600, 4000]))
def test_stretches_are_ordered_and_do_not_depend_on_the_runs(kinds, limit, silence):
    found = stretches(kinds, min_silence=silence, limit=limit)
    assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    if limit == float("inf"):
        assert all(kinds[a] == "#" for a, _ in found)


def test_long_speech_is_cut_at_its_last_pause():
    assert stretches("##########", limit=4800) == [(0, 4), (5, 9)]  # on the spot, and on with the next window; the rest is too short
    assert stretches("####...####", min_silence=8000, limit=12_800) == [(0, 4), (7, 11)]
    assert stretches("###-...-..", min_silence=16_000, limit=12_800) == [(0, 4)]  # quiet since, so nothing goes on
    assert stretches("####.#.####", min_silence=8000, limit=12_800) == [(0, 9)]  # pauses of one window are no place to cut


def test_transcript_files(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, 0, 100, ' say "hi"'), (1, 1, 100, 250, " bye")], "audio_id int, seg_no int, t0 long, t1 long, text string")
    text = lambda kind: [r.value for r in speech.cues(s, kind).orderBy("no").collect()]
    assert text("csv") == ["start,end,text", '0,1000," say ""hi"""', '1000,2500," bye"']
    assert text("srt")[1] == "2\n00:00:01,000 --> 00:00:02,500\n bye\n" and text("vtt")[:2] == ["WEBVTT\n", '00:00:00.000 --> 00:00:01.000\n say "hi"\n']
    assert text("lrc")[2] == "[00:01.00] bye" and text("txt") == [' say "hi"', " bye"]
    logs.write_transcript(speech.cues(s, "csv"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == text("csv")
    tokens = spark.createDataFrame([(1, 0, 0, "a", 0.5)], "audio_id int, seg_no int, tok_no int, text string, p double")
    assert speech.token_scores(tokens).first().value == "a\t0.5"
    assert speech.last_events(spark.createDataFrame([("s", i) for i in range(9)], "source string, ts int"), 3).count() == 3


def test_log_cleaning(spark):
    log = "whisper_init: x\n\x1b[2K[00:00.000 --> 00:01.000]  hello \nmain: y\n\n  there\r\nmother_in_law: z\n[noise]\nsystem_info: n\nx whisper_print_timings: 1 ms"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(telemetry.clean_transcript_log(F.lit(log))) == "hello there mother_in_law: z"
    chunk = "Script started on\nggml_x\n[BLANK_AUDIO]\nNvRm z\n### a\n[00:00.000 --> 00:01.000]  hello\nrequired: 3\n[Start speaking]\nold\r" + " " * 30 + "\rnew [BLANK_AUDIO]\n"
    assert one(telemetry.clean_transcript_chunk(F.lit(chunk))) == "hello\nold\nnew\n" and one(telemetry.clean_transcript_chunk(F.lit("main: x"))) == ""
    assert one(telemetry.build_config(F.lit("AVX2 = 0 | NEON = 1 | CUDA : ARCHS = 8 | CUDA = 1"))) == " NEON CUDA"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(limit))] for limit in (70, 140))
        assert speechtext.edit_distance(a, b) == speechtext.edit_distance(b, a) == plain_distance(a, b)
    whole = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    heard = [w if rng.random() > 0.1 else "x" for w in whole if rng.random() > 0.1]
    assert 0.15 < speechtext.edit_distance(whole, heard) / len(whole) < 0.2
