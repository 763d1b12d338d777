import random

from strandlake.__main__ import main, parser


def test_commands_from_end_to_end(spark, tmp_path, capsys):
    r = random.Random(1)
    seq = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    p = lambda name: str(tmp_path / name)
    (tmp_path / "ref.fasta").write_text(f">chrA one\n{seq(3000)}\n>chrB two\nNNN{seq(2000)}\n")
    main(["index", p("ref.fasta"), p("ix"), "--k", "200", "--kstep", "20", "--precision", "f32"])
    main(["sample", p("ref.fasta"), p("reads.fasta"), "--n", "30", "--k", "200", "--err", "0.02"])
    main(["map", p("ix"), p("reads.fasta"), p("maps"), "--topk", "3"])
    main(["verify", p("reads.fasta"), p("maps"), "--k", "200"])
    assert "|30 " in capsys.readouterr().out
    main(["separate", p("reads.fasta"), p("sep")])
    main(["subset", p("ref.fasta"), p("sub.fasta"), "^>chrB"])
    main(["nruns", p("ref.fasta"), p("runs")])
    main(["pool", p("ref.fasta"), "--k", "200"])
    main(["check-sample", p("ref.fasta"), p("reads.fasta"), "--k", "200", "--err", "0.02"])
    main(["random", p("r.fasta"), "--n", "2", "--length", "50"])
    main(["convert", p("sub.fasta"), p("sub.parquet")])
    assert spark.read.parquet(p("sub.parquet")).count() == 1
    assert parser().parse_args(["paf", "x"]).threshold == 20_000
