import os

from pyspark.sql import functions as F

from chronoloom.sources import readers, sinks


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_arff(spark, tmp_path):
    head = "% a comment\n@relation x\n@attribute r relational\n@attribute a0 numeric\n@end r\n@attribute c {b,a}\n@data\n"
    write(f"{tmp_path}/ERing/ERing_TRAIN.arff", head + "'1.0,2.5\\n3,?',b\n\n'5,6\\n7,8',a\n")
    write(f"{tmp_path}/ERing/ERing_TEST.arff", head + "'9,10\\n11,12',a\n")
    rows = readers.get_dataset(spark, "ERing", str(tmp_path)).orderBy("sample_id").collect()
    assert [(r.split, r.sample_id, r.series, r.label_name, r.label) for r in rows] == [
        ("train", 0, [[1.0, 2.5], [3.0, None]], "b", 1), ("train", 1, [[5.0, 6.0], [7.0, 8.0]], "a", 0), ("test", 2, [[9.0, 10.0], [11.0, 12.0]], "a", 0)]
    os.rename(f"{tmp_path}/ERing", f"{tmp_path}/Other")
    for s in ("TRAIN", "TEST"):
        os.rename(f"{tmp_path}/Other/ERing_{s}.arff", f"{tmp_path}/Other/Other_{s}.arff")
    pooled = {r.sample_id: (r.split, r.label) for r in readers.get_dataset(spark, "Other", str(tmp_path)).collect()}
    assert sorted(v for v in pooled.values()) == [("test", 0), ("test", 1), ("train", 0)]


def test_lines_of_files_in_blocks(spark, tmp_path):
    """Line numbers hold when a file is read in several blocks."""
    write(f"{tmp_path}/a.txt", "".join(f"{k} {'x' * (k % 7)}\n" for k in range(3000)))
    write(f"{tmp_path}/b.txt", "0\n1\n2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.numbered_lines(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3003 and all(int(r.value.split()[0]) == r.line_no for r in rows)


def test_har(spark, tmp_path):
    for split in ("train", "test"):
        for c in ("acc_x", "acc_y"):
            write(f"{tmp_path}/{split}/Signals/{c}_{split}.txt", f"  1.0e+00  2.0\n 3 {len(split)}\n")
        write(f"{tmp_path}/{split}/y_{split}.txt", "5\n1\n")
    rows = readers.har_dataset(spark, str(tmp_path)).orderBy(F.desc("split"), "sample_id").collect()
    assert len(rows) == 4 and rows[0].series == [[1.0, 2.0], [1.0, 2.0]] and [r.label for r in rows] == [5, 1, 5, 1] and rows[1].series[0] == [3.0, 5.0] and [r.sample_id for r in rows] == [0, 1, 2, 3]


def test_dsa(spark, tmp_path):
    write(f"{tmp_path}/a02/p1/s03.txt", "1,2,3\n4,5,6\n")
    write(f"{tmp_path}/a01/p8/s60.txt", "7,8,9\n1,1,1\n")
    rows = readers.dsa_dataset(spark, str(tmp_path)).orderBy("activity").collect()
    assert {r.split for r in rows} <= {"train", "test"} and sorted(r.sample_id for r in rows) == [0, 1]
    assert [(r.activity, r.person, r.segment, r.label) for r in rows] == [(1, 8, 60, 0), (2, 1, 3, 1)] and rows[1].series == [[1.0, 4.0], [2.0, 5.0], [3.0, 6.0]]


def test_eeg(spark, tmp_path):
    write(f"{tmp_path}/co2a0000364.rd.000", "# header\n# trial 0\n0 FP1 1 -8.9\n0 FP1 0 2\n0 C3 0 1.5\n0 C3 1 n/a\n")
    write(f"{tmp_path}/co2c0000337.rd.001", "1 C3 0 3\n")
    r = readers.eeg_readings(spark, f"{tmp_path}/*")
    out = readers.eeg_series(r).orderBy("file_name").collect()
    assert [(x.class_code, x.sensors, x.series) for x in out] == [(1, ["C3", "FP1"], [[1.5, None], [2.0, -8.9]]), (0, ["C3"], [[3.0]])]


def test_points_and_parameters(spark, tmp_path):
    write(f"{tmp_path}/p.dat", "x\ty\tnum\n1.5\t2\t3\n4\t5\t1\n")
    assert [tuple(r) for r in readers.point_set(spark, f"{tmp_path}/p.dat").orderBy("id").collect()] == [(0, [1.5, 2.0], 3), (1, [4.0, 5.0], 1)]
    names = [c.split()[0] for c in readers.PARAMETER_SCHEMA.split(", ")]
    write(f"{tmp_path}/par.csv", ",".join(names) + "\nA,25,10,1e-1,1e-1,0.002,0.05,800,True,50,5,1e-12,1e12,1000\n")
    r = readers.parameters(spark, f"{tmp_path}/par.csv").first()
    assert r.dataset == "A" and r.width == 25 and r.dimension_reduce is True and r.k_dis_high == 1e12


def test_sinks(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    folder = f"file://{tmp_path}"
    assert sinks.cached(spark, folder, "x", make, a=1).count() == 3 and sinks.cached(spark, folder, "x", make, a=1).count() == 3 and len(made) == 1
    assert sinks.cache_path(folder, "x", a=1) != sinks.cache_path(folder, "x", a=2)
    for _ in range(2):
        sinks.append_log(spark.range(2), f"{folder}/log")
    assert spark.read.json(f"{folder}/log").count() == 4
    sinks.csv_table(spark.range(2), f"{folder}/t")
    assert spark.read.csv(f"{folder}/t", header=True).columns == ["id"]
