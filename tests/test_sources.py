"""Readers, writers and the streaming counters."""

import gzip
import json

import pytest

from tesserae.functions import rules as r
from tesserae.operators import genes
from tesserae.operators.dynamics import Ensemble, ExecutableModel, Network
from tesserae.sources import catalogue, models, readers, resources, writers
from tesserae.streaming import counters


def test_bnet_files(spark, tmp_path):
    (tmp_path / "light.bnet").write_text("# who switches whom\nlamp, door & !night\n\ndoor, 1\nnight, 0 # never\n")
    (tmp_path / "loop.bnet").write_text("left, right\nright, (left | right)\n")
    one = readers.read_bnet(spark, str(tmp_path / "light.bnet"))
    rules = {"lamp": "door & ~night", "door": "1", "night": "0"}
    assert {q.component: q.rule for q in one.collect()} == rules
    both = readers.read_bnet(spark, str(tmp_path), recursive=True)
    assert both.select("network").distinct().count() == 2 and readers.validate_network(both).count() == 0
    net = Network(rules)
    (tmp_path / "copy.bnet").write_text(writers.bnet_text(net))
    assert {q.component: q.rule for q in readers.read_bnet(spark, str(tmp_path / "copy.bnet")).collect()} == rules
    writers.write_bnet(one, str(tmp_path / "out.bnet"))
    assert readers.read_bnet(spark, str(tmp_path / "out.bnet")).count() == 3
    assert writers.exchange_text(net, "mpbn").splitlines()[0] == "lamp, door & !night"
    with pytest.raises(ValueError):
        writers.exchange_text(net, "word")


def test_hypercubes(spark, tmp_path):
    (tmp_path / "columns.csv").write_text(",dawn,dusk\nlamp,1,*\ndoor,,1\n")
    want = {("dawn", "lamp", True), ("dawn", "door", None), ("dusk", "lamp", None), ("dusk", "door", True)}
    assert {tuple(q) for q in readers.read_hypercubes(spark, str(tmp_path / "columns.csv")).collect()} == want
    (tmp_path / "rows.csv").write_text("when,lamp,door\ndawn,true,\ndusk,*,1.0\n")
    assert {tuple(q) for q in readers.read_hypercubes(spark, str(tmp_path / "rows.csv"), "rows").collect()} == want
    (tmp_path / "both.json").write_text(json.dumps({"dawn": {"lamp": 1, "door": "*"}, "dusk": {"lamp": "*", "door": 1}}))
    assert {tuple(q) for q in readers.read_hypercubes(spark, str(tmp_path / "both.json")).collect()} == want


def test_edges(spark, tmp_path):
    (tmp_path / "signed.csv").write_text("source,target,sign,paper\nfox,hare,-1,p1\ngrass,hare,positive,p2\nhare,grass,?,p3\n")
    got = readers.read_influence_graph(spark, str(tmp_path / "signed.csv"))
    assert {(q.source, q.sign, q.paper) for q in got.collect()} == {("fox", -1, "p1"), ("grass", 1, "p2")}
    (tmp_path / "bare.csv").write_text("source,target\nfox,hare\n")
    with pytest.raises(ValueError):
        readers.read_influence_graph(spark, str(tmp_path / "bare.csv"))
    writers.write_dot(got, str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).count() == 2


def test_matrix_market(spark, tmp_path):
    x = spark.createDataFrame([(0, 1, 2.5), (2, 0, 1.0), (1, 1, 3.0)], "row long, col long, value double")
    writers.write_mtx(x, str(tmp_path / "m"), 3, 2)
    parts = sorted((tmp_path / "m").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.splitlines() == ["%%MatrixMarket matrix coordinate real general", "3 2 3", "1 2 2.5", "2 2 3.0", "3 1 1.0"]
    folder = tmp_path / "tenx"
    folder.mkdir()
    with gzip.open(folder / "matrix.mtx.gz", "wt") as f:
        f.write(text)
    (folder / "barcodes.tsv").write_text("c1\nc2\n")
    (folder / "genes.tsv").write_text("g1\tx\ng2\ty\ng3\tz\n")
    assert {tuple(q) for q in readers.read_10x(spark, str(folder)).collect()} == {("c2", "g1", 2.5), ("c2", "g2", 3.0), ("c1", "g3", 1.0)}
    writers.write_coordinates(x, str(tmp_path / "coo"))
    assert spark.read.parquet(str(tmp_path / "coo")).count() == 3


def test_parts_are_read_in_the_order_of_their_names(spark, tmp_path):
    """The larger parts come last by name; Spark deals them out first."""
    folder = tmp_path / "parts"
    folder.mkdir()
    rows = [(i, i % 7, i + 0.5) for i in range(4000)]
    lines = [f"{i + 1} {j + 1} {v}" for i, j, v in rows]
    (folder / "part-0.txt").write_text(f"%%MatrixMarket matrix coordinate real general\n4000 7 4000\n{lines[0]}\n")
    (folder / "part-1.txt").write_text("\n".join(lines[1:1500]) + "\n")
    (folder / "part-2.txt").write_text("\n".join(lines[1500:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # more than one block a file, and tasks for each
    spark.conf.set("spark.sql.files.openCostInBytes", "16k")
    try:
        assert sorted(map(tuple, readers.read_mtx(spark, str(folder)).collect())) == rows
        numbered = readers._numbered(spark, str(folder)).orderBy("row_no").collect()
        assert [q.row_no for q in numbered] == list(range(4002)) and [q.value for q in numbered][2:] == lines
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_gene_info(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("#tax\tx\n1\tA\tA1\tal|be\tMGI:5|Ensembl:E1|MGI:6\t3\tncRNA\n2\t-\tB\t-\t-\t-\tpseudo\n")
    got = {q.gene_id: q for q in readers.read_gene_info(spark, str(tmp_path / "g.tsv")).collect()}
    assert got["1"].synonyms == ["al", "be"] and got["1"].ensembl_id == "E1" and got["1"].databases == {"MGI": "6"}
    assert got["2"].synonyms == [] and got["2"].ensembl_id is None and got["2"].gene_type == "pseudo"


SBML = """<sbml xmlns="http://www.sbml.org/sbml/level3/version1/core" xmlns:qual="http://www.sbml.org/sbml/level3/version1/qual/version1" level="3" version="1"><model>
<qual:listOfQualitativeSpecies><qual:qualitativeSpecies qual:id="in" qual:constant="true"/><qual:qualitativeSpecies qual:id="X" qual:maxLevel="2"/><qual:qualitativeSpecies qual:id="Y"/></qual:listOfQualitativeSpecies>
<qual:listOfTransitions><qual:transition><qual:listOfOutputs><qual:output qual:qualitativeSpecies="Y" qual:transitionEffect="assignmentLevel"/></qual:listOfOutputs><qual:listOfFunctionTerms><qual:defaultTerm qual:resultLevel="0"/>
<qual:functionTerm qual:resultLevel="1"><math xmlns="http://www.w3.org/1998/Math/MathML"><apply><and/><apply><geq/><ci>X</ci><cn>2</cn></apply><apply><eq/><ci>in</ci><cn>0</cn></apply></apply></math></qual:functionTerm></qual:listOfFunctionTerms></qual:transition>
<qual:transition><qual:listOfOutputs><qual:output qual:qualitativeSpecies="X"/></qual:listOfOutputs><qual:listOfFunctionTerms><qual:defaultTerm qual:resultLevel="0"/>
<qual:functionTerm qual:resultLevel="2"><math xmlns="http://www.w3.org/1998/Math/MathML"><apply><eq/><ci>in</ci><cn>1</cn></apply></math></qual:functionTerm></qual:listOfFunctionTerms></qual:transition></qual:listOfTransitions></model></sbml>"""


def test_sbml(spark, tmp_path):
    (tmp_path / "m.sbml").write_text(SBML)
    net = models.read_sbml(spark, str(tmp_path / "m.sbml"))
    assert net.components == ["in", "X_b1", "X_b2", "Y"]
    assert r.equivalent(net.rules["Y"], r.parse("X_b1 & X_b2 & ~in")) and r.equivalent(net.rules["in"], r.parse("in"))
    assert r.equivalent(net.rules["X_b1"], r.parse("in | X_b1 & X_b2")) and r.equivalent(net.rules["X_b2"], r.parse("X_b1 & in"))
    with pytest.raises(ValueError):
        models.parse_sbml(SBML.replace("assignmentLevel", "production").encode())


GINML = """<gxl><graph id="g"><node id="A" maxvalue="1" input="true"/><node id="B" maxvalue="1"><value val="1"><exp str="A &amp; !C"/></value></node><node id="C" maxvalue="1"><parameter idActiveInteractions="A_C" val="1"/></node>
<edge id="A_B" from="A" to="B" minvalue="1"/><edge id="C_B" from="C" to="B" minvalue="1"/><edge id="A_C" from="A" to="C" minvalue="1"/><edge id="B_C" from="B" to="C" minvalue="1"/></graph></gxl>"""


def test_ginml(spark, tmp_path):
    import zipfile

    (tmp_path / "m.ginml").write_text(GINML)
    with zipfile.ZipFile(tmp_path / "m.zginml", "w") as z:
        z.write(tmp_path / "m.ginml", "m.ginml")
    for net in (models.read_ginml(spark, str(tmp_path / "m.ginml")), models.read_zginml(spark, str(tmp_path / "m.zginml"))):
        assert r.equivalent(net.rules["B"], r.parse("A & ~C")) and r.equivalent(net.rules["C"], r.parse("A & ~B")) and r.equivalent(net.rules["A"], r.parse("A"))


def test_stream_equals_table(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(src)
    spark.read.parquet(src).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = counters.windowed_totals(stream).writeStream.outputMode("update").format("memory").queryName("totals").start()
    query.processAllAvailable()
    query.stop()
    whole = counters.windowed_totals(table)
    got = {(q.start, q.cell, q.gene): (round(q.value, 6), q.n) for q in spark.table("totals").collect()}
    assert got == {(q.start, q.cell, q.gene): (round(q.value, 6), q.n) for q in whole.collect()}
    assert counters.running_qc(whole).count() > 0


def test_models_are_saved_and_read_back(spark, tmp_path):
    net = Network({"door": "door", "lamp": "door ^ night", "night": "~lamp | door", "off": "0"})
    model = ExecutableModel(net, {"evening": {"door": True, "night": False}}, parameters={"speed": 1}, metadata={"by": "test"})
    path = str(tmp_path / "m.zginml")
    writers.save_model(model, path)
    back = models.read_model(spark, path)
    assert back.network.components == net.components and back.initial == model.initial
    assert all(r.equivalent(back.network.rules[c], net.rules[c]) for c in net.components)
    assert model.parameters == {"speed": 1} and model.metadata == {"by": "test"}
    with pytest.raises(ValueError):
        writers.save_model(model, str(tmp_path / "m.txt"))


def test_conditions_and_quantifiers(spark):
    model = ExecutableModel(Network({"a": "a | b", "b": "b", "c": "a"}), {"start": {"a": False, "b": True, "c": False}})
    assert model.transition(spark, "start", {"a": True}) and not model.transition(spark, "start", {"a": True, "c": True}, "asynchronous", "exists")
    assert model.reachability(spark, "start", {"a": True, "c": True}) and not model.reachability(spark, "start", {"b": False}, quantifier="exists")


def test_ensembles_keep_one_set_of_components(spark):
    e = Ensemble([Network({"a": "b", "b": "1"})])
    e.append({"a": "0", "b": "a"})
    e.insert(0, {"b": "a", "a": "a"})
    e[1] = {"a": "1", "b": "0"}
    assert len(e) == 3 and r.to_text(e[1].rules["a"]) == "1" and e.frame(spark).count() == 6
    e[0:2] = [{"a": "b", "b": "b"}]
    del e[0]
    assert [r.to_text(n.rules["b"]) for n in e] == ["a"]
    with pytest.raises(ValueError):
        e.append({"a": "1"})
    assert len(Ensemble(components=["a"])) == 0


HCOP = """human_symbol\tmouse_symbol\trat_symbol\tc.elegans_symbol\tsupport
GENE1\tGene1\tGene1r\tgen-1\tA,B,C,D
GENE1\tGene1b\t-\tgen-1\tA,B,C
GENE2\tGene1\tGene2r\tgen-2\tA,B,C
GENE3\tGene3\tGene3r\tgen-3\tA
-\tGene4\tGene4r\tgen-4\tA,B,C,D
"""


def test_ortholog_tables(spark, tmp_path):
    (tmp_path / "hcop.tsv").write_text(HCOP)
    path = str(tmp_path / "hcop.tsv")
    rows = {(q.source, q.target, q.evidence) for q in resources.read_hcop(spark, path, "mouse").collect()}
    assert rows == {("GENE1", "Gene1", 4), ("GENE1", "Gene1b", 3), ("GENE2", "Gene1", 3)}
    assert resources.read_hcop(spark, path, "c.elegans", 1).count() == 4
    to_human = {(q.source, q.target, q["rank"]) for q in resources.read_orthologs(spark, {"mouse": path}, "human", "mouse").collect()}
    assert to_human == {("Gene1", "GENE1", 1), ("Gene1", "GENE2", 2), ("Gene1b", "GENE1", 1)}
    across = {(q.source, q.target, q.evidence) for q in resources.read_orthologs(spark, {"mouse": path, "rat": path}, "rat", "mouse").collect()}
    assert across == {("Gene1", "Gene1r", 4), ("Gene1", "Gene2r", 3), ("Gene1b", "Gene1r", 3)}
    lists = {q.source: q.targets for q in resources.ortholog_lists(resources.read_orthologs(spark, {"mouse": path}, "mouse")).collect()}
    assert lists == {"GENE1": ["Gene1", "Gene1b"], "GENE2": ["Gene1"]}
    for bad in (lambda: resources.read_hcop(spark, path, "human"), lambda: resources.read_hcop(spark, path, "cat"), lambda: resources.read_hcop(spark, path, "mouse", 0)):
        with pytest.raises(ValueError):
            bad()


ARCHIVE = """source\ttarget\tsource_genesymbol\ttarget_genesymbol\tis_stimulation\tis_inhibition\tconsensus_stimulation\tconsensus_inhibition\tcollectri\tdorothea\tdorothea_level\tncbi_tax_id_target\tunused
1\t2\tTF1_TF2\tT\tTrue\tFalse\tTrue\tFalse\tTrue\tFalse\t\t9606\tx
1\t3\tTF1\tU\tFalse\tTrue\tFalse\tTrue\tTrue\tTrue\tA;B\t9606\tx
1\t4\tTF1\tV\tTrue\tTrue\tTrue\tTrue\tTrue\tTrue\tD\t9606\tx
1\t5\tTF1\tW\tTrue\tFalse\tTrue\tFalse\tFalse\tTrue\tC\t10090\tx
"""


def test_interaction_archives(spark, tmp_path):
    for name in ("20200101-20201231.tsv", "20210101-20211231.tsv"):
        (tmp_path / f"omnipath_webservice_interactions__{name}").write_text(ARCHIVE if "2021" in name else ARCHIVE.splitlines()[0] + "\n")
    folder = str(tmp_path)
    assert [q.version for q in resources.archive_versions(spark, folder).orderBy("start").collect()] == ["2020-01-01..2020-12-31", "2021-01-01..2021-12-31"]
    assert "20200101" in resources.resolve_archive(spark, folder, "2020-06-15") and "2021" in resources.resolve_archive(spark, folder)
    with pytest.raises(ValueError):
        resources.resolve_archive(spark, folder, "2019-01-01")
    path = resources.resolve_archive(spark, folder)
    assert "unused" not in resources.read_interactions(spark, path, "collectri").columns
    assert {tuple(q) for q in resources.collectri(spark, path).collect()} == {("TF1_TF2", "T", 1), ("TF1", "U", -1)}
    assert resources.collectri(spark, path, split=True).count() == 3
    assert {tuple(q) for q in resources.dorothea(spark, path).collect()} == {("TF1", "U", -1, "A"), ("TF1", "W", 1, "C")}
    assert resources.load_interactions_version(spark, folder, "dorothea", "2021-02-02", organism=10090).count() == 1
    assert resources.load_interactions_version(spark, folder, "collectri", "2020-02-02").count() == 0
    with pytest.raises(ValueError):
        resources.read_interactions(spark, path, "other")


def test_identifier_types(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("1\tA\tA1\tal\tMGI:5|Ensembl:E1\t3\tncRNA\n2\tB\tB\t-\tHGNC:7\t-\tpseudo\n")
    info = readers.read_gene_info(spark, str(tmp_path / "g.tsv"))
    assert resources.databases(info) == ["HGNC", "MGI"]
    assert resources.input_identifier_types(info) == ("name", "gene_id", "ensembl_id", "HGNC", "MGI")
    assert {tuple(q) for q in resources.by_identifier(info, "MGI").collect()} == {("5", "1")}
    assert {tuple(q) for q in resources.by_identifier(info, "ensembl_id").collect()} == {("E1", "1")}
    assert {(q.gene_id, q.HGNC) for q in resources.with_identifiers(info, "HGNC").collect()} == {("1", None), ("2", "7")}
    mapping = genes.alias_mapping(resources.by_identifier(info, "name"), info, spark.createDataFrame([("al",), ("b",), ("zz",)], "old string"))
    assert genes.network_mapping(["al", "zz"], mapping) == {"al": "A"}


def test_catalogue(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    c = catalogue.Catalogue()
    c.register("numbers", str(tmp_path / "p"), about="three of them")
    assert c.available() == ["numbers"] and c.load(spark, "numbers").count() == 3 and c.info("numbers")["about"] == "three of them"
    c.clear("numbers")
    with pytest.raises(KeyError):
        c.info("numbers")
    with pytest.raises(ValueError):
        c.register("x", "y", "zip")
