import re

from chronoloom.sources.lines import classify_lines, predictions_loaded, turns_loaded

H = "ab" * 32


def outcome(spark, rows):
    df = spark.createDataFrame([(i, f, r) for i, (f, r) in enumerate(rows)], "line_id BIGINT, fmt STRING, raw STRING")
    return classify_lines(df)


def kinds(spark, fmt, lines):
    return [r.reason or r.kind for r in outcome(spark, [(fmt, x) for x in lines]).orderBy("line_id").collect()]


def test_rttm(spark):
    ok = "SPEAKER f 1 {} {} <NA> <NA> S <NA> <NA>"
    cases = [
        (ok.format("1", "2"), "load"), (ok.format("0", "0"), "VALUE"), (ok.format("86399.5", "0.5"), "load"), (ok.format("86399.5", "0.5000000000000000000001"), "VALUE"),
        (ok.format("0." + "0" * 30 + "1", "0." + "0" * 30 + "1"), "load"), (ok.format("9" * 400, "1"), "VALUE"), (ok.format("1.", "1"), "VALUE"), (ok.format(".5", "1"), "VALUE"),
        (ok.format("１", "1"), "VALUE"), (ok.format("-1", "1"), "VALUE"), (ok.format("1e1", "1"), "VALUE"), ("\t" + ok.format("1", "1").replace(" ", "\t \t") + "  ", "load"),
        (ok.format("1", "1").replace(" f ", f" {'f' * 128} "), "load"), (ok.format("1", "1").replace(" f ", f" {'f' * 129} "), "VALUE"), (ok.format("1", "1").replace(" f ", " -f "), "VALUE"),
        ("SPEAKER f 1 1 1", "COLUMN_COUNT"), (ok.format("1", "1") + " x", "COLUMN_COUNT"), ("spEAKer f 1 1 1 a b c d e", "load"), ("LEXEME f 1 1 1 a b c d e", "VALUE"),
        ("", "skip"), (" \t ", "skip"), ("  # x", "skip"), (None, "skip"), ("x " * 100_000, "COLUMN_COUNT"), (ok.format("000000000000000000000000000001", "1"), "load"),
    ]
    assert kinds(spark, "rttm", [c for c, _ in cases]) == [k for _, k in cases]


FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'


def brute_pred(line):
    if not re.fullmatch(f"{FIELD}(?:,{FIELD})*", line, re.S):
        return "QUOTING"
    values = [m[1:-1].replace('""', '"') if m.startswith('"') else m for m in re.findall(f"({FIELD})(?:,|$)", line + ",", re.S)][: line.count(",") + 1]
    parts, rest = [], line + ","
    while rest:
        m = re.match(f"({FIELD}),", rest, re.S)
        parts.append(m[1])
        rest = rest[m.end():]
    values = [p[1:-1].replace('""', '"') if p.startswith('"') else p for p in parts]
    if len(values) != 4:
        return "COLUMN_COUNT"
    good = re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.\-]{0,127}", values[0]) and values[1] and re.fullmatch("[0-9a-fA-F]{64}", values[2]) and values[3] in ("PASS_HIGH", "UNSUPPORTED")
    return "load" if good else "VALUE"


def test_pred_against_brute_force(spark):
    import random

    rng = random.Random(1)
    lines = [f"f,r,{H},PASS_HIGH", f'"f","r,1",{H.upper()},"PASS_HIGH"', f'f,"a""b",{H},PASS_HIGH', f'f,a"b,{H},PASS_HIGH', f'f, "r",{H},PASS_HIGH', f'f,"",{H},PASS_HIGH', f"f,,{H},PASS_HIGH", '"', '""', '"""', '""""', f'f,"r,{H},PASS_HIGH', "," * 50_000, '"' + "q" * 60_000 + '",b,c,d']
    lines += ["".join(rng.choice('a",x') for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    assert kinds(spark, "pred", lines) == [brute_pred(x) for x in lines]


def test_loading_and_header(spark):
    c = outcome(spark, [("pred", "audio_id,rttm,rttm_sha256,quality_status"), ("pred", f'"f","a""b",{H},UNSUPPORTED'), ("rttm", "SPEAKER f 2 1.0000005 2.0000010 a b S d e"), ("csv", "x"), (None, "x")])
    assert [r.rttm for r in predictions_loaded(c, ["line_id"]).collect()] == ['a"b']
    assert [(r.file_id, r.channel, r.speaker_id, r.start_us, r.end_us) for r in turns_loaded(c, []).collect()] == [("f", "2", "S", 1000000, 3000002)]
    assert c.where("kind = 'skip'").count() == 3
    assert outcome(spark, []).count() == 0
