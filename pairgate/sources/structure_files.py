"""Structure text (PDB and mmCIF) to the atoms table, with built-in functions only.

One input row is one file.  Kept: the first model, ATOM records, and for alternate locations the
one with the highest occupancy (the first on a tie).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgate import constants as C

_RAW = (
    "structure_id",
    "line_no",
    "chain_id",
    "resseq",
    "icode",
    "resname",
    "atom_name",
    "occupancy",
    "element",
    "x",
    "y",
    "z",
)


def one_letter(resname: Column | str, unknown: str | None = "X") -> Column:
    """One-letter code of a residue name; ``unknown`` for anything else."""
    name = F.col(resname) if isinstance(resname, str) else resname
    table = F.create_map(*[F.lit(v) for pair in C.THREE_TO_ONE.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.upper(name)), F.lit(unknown))


def _lines(files: DataFrame, text: Column) -> DataFrame:
    return files.select("structure_id", F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def _cell(start: int, stop: int) -> Column:
    """Fixed-width cell, given as a 0-based half-open range."""
    return F.substring("line", start + 1, stop - start)


def _element(symbol: Column, atom_name: Column) -> Column:
    """The element column, or the first letter of the atom name when it is blank."""
    given = F.upper(F.trim(symbol))
    return F.when(given != "", given).otherwise(F.upper(F.regexp_extract(atom_name, "[A-Za-z]", 0)))


def pdb_atom_lines(files: DataFrame) -> DataFrame:
    """ATOM records of the first model, cut into trimmed text cells."""
    first_model = F.substring_index("text", "\nENDMDL", 1)
    return (
        _lines(files, first_model)
        .where(F.trim(_cell(0, 6)) == "ATOM")
        .select(
            "structure_id",
            "line_no",
            _cell(21, 22).alias("chain_id"),
            F.trim(_cell(22, 26)).try_cast("int").alias("resseq"),
            _cell(26, 27).alias("icode"),
            F.trim(_cell(17, 20)).alias("resname"),
            F.trim(_cell(12, 16)).alias("atom_name"),
            F.coalesce(F.trim(_cell(54, 60)).try_cast("double"), F.lit(1.0)).alias("occupancy"),
            _element(_cell(76, 78), F.trim(_cell(12, 16))).alias("element"),
            *[
                F.trim(_cell(a, a + 8)).try_cast("double").alias(axis)
                for axis, a in (("x", 30), ("y", 38), ("z", 46))
            ],
        )
        .where(F.col("resseq").isNotNull())
    )


def cif_atom_lines(files: DataFrame) -> DataFrame:
    """Rows of the _atom_site loop that belong to the first model and are ATOM records."""
    pattern = r"(?s)((?:_atom_site\.[^\n]*\n)+)(.*?)(?:\n#|\nloop_|\n_|\z)"
    token = r"(\"[^\"]*\"|'[^']*'|\S+)"
    plain = F.regexp_replace("text", "\r\n", "\n")
    loops = files.select(
        "structure_id",
        F.regexp_extract(plain, pattern, 1).alias("head"),
        F.regexp_extract(plain, pattern, 2).alias("body"),
    ).select(
        "structure_id",
        F.transform(
            F.filter(F.split("head", "\n"), lambda h: F.trim(h) != ""),
            lambda h: F.trim(F.substring_index(h, ".", -1)),
        ).alias("names"),
        F.filter(F.split("body", "\n"), lambda r: F.trim(r) != "").alias("rows"),
    )
    rows = loops.select("structure_id", "names", F.posexplode("rows").alias("line_no", "line"))
    cells = rows.select(
        "structure_id", "line_no", "names", F.regexp_extract_all("line", F.lit(token), 1).alias("cells")
    )

    def field(*names: str) -> Column:
        found = [
            F.when(
                F.array_contains("names", n), F.try_element_at("cells", F.array_position("names", n).cast("int"))
            )
            for n in names
        ]
        value = F.coalesce(*found)
        return F.regexp_replace(value, "^['\"]|['\"]$", "")

    parsed = cells.select(
        "structure_id",
        "line_no",
        field("group_PDB").alias("record"),
        field("pdbx_PDB_model_num").alias("model"),
        field("auth_asym_id", "label_asym_id").alias("chain_id"),
        field("auth_seq_id", "label_seq_id").try_cast("int").alias("resseq"),
        F.when(field("pdbx_PDB_ins_code").isin("?", "."), " ")
        .otherwise(F.coalesce(field("pdbx_PDB_ins_code"), F.lit(" ")))
        .alias("icode"),
        field("label_comp_id").alias("resname"),
        field("label_atom_id").alias("atom_name"),
        F.coalesce(field("occupancy").try_cast("double"), F.lit(1.0)).alias("occupancy"),
        _element(F.coalesce(field("type_symbol"), F.lit("")), field("label_atom_id")).alias("element"),
        field("Cartn_x").try_cast("double").alias("x"),
        field("Cartn_y").try_cast("double").alias("y"),
        field("Cartn_z").try_cast("double").alias("z"),
    )
    first = F.min_by("model", "line_no").over(Window.partitionBy("structure_id"))
    return (
        parsed.withColumn("first_model", first)
        .where(F.col("model").eqNullSafe(F.col("first_model")) & (F.coalesce("record", F.lit("ATOM")) == "ATOM"))
        .select(*_RAW)
    )


def number_atoms(raw: DataFrame) -> DataFrame:
    """Resolve alternate locations and number chains, residues and atoms in file order.

    Every step is keyed by the structure, so one shuffle serves them all.
    """
    residue = ["structure_id", "chain_id", "resseq", "icode"]
    value = F.struct("resname", "element", "x", "y", "z")
    atoms = (
        raw.repartition("structure_id")
        .groupBy(*residue, "atom_name")
        .agg(
            F.min("line_no").alias("line_no"),
            F.max_by(value, F.struct("occupancy", -F.col("line_no"))).alias("v"),
        )
        .select(*residue, "atom_name", "line_no", "v.*")
    )
    chain = Window.partitionBy("structure_id", "chain_id")
    within = Window.partitionBy(*residue)
    first = atoms.withColumn("chain_line", F.min("line_no").over(chain)).withColumn(
        "res_line", F.min("line_no").over(within)
    )
    by_structure = Window.partitionBy("structure_id")
    return (
        first.withColumn("chain_ord", F.dense_rank().over(by_structure.orderBy("chain_line")) - 1)
        .withColumn("res_ord", F.dense_rank().over(chain.orderBy("res_line")) - 1)
        .withColumn(
            "atom_ord", F.row_number().over(by_structure.orderBy("chain_line", "res_line", "line_no")) - 1
        )
        .withColumn("resname", F.first("resname").over(within.orderBy("line_no")))
        .select(
            "structure_id",
            "chain_id",
            "chain_ord",
            "res_ord",
            "resseq",
            "icode",
            "resname",
            "atom_ord",
            "atom_name",
            "element",
            "x",
            "y",
            "z",
        )
    )


def atoms_from_files(files: DataFrame) -> DataFrame:
    """Atoms of (structure_id, path, text) rows, the format chosen by the file suffix."""
    is_cif = F.lower("path").endswith(".cif")
    raw = (
        pdb_atom_lines(files.where(~is_cif))
        .select(*_RAW)
        .unionByName(cif_atom_lines(files.where(is_cif)).select(*_RAW))
    )
    return number_atoms(raw)


def residues(atoms: DataFrame) -> DataFrame:
    """One row per residue with its one-letter code, X when it is not standard."""
    return (
        atoms.groupBy("structure_id", "chain_id", "chain_ord", "res_ord")
        .agg(F.min_by("resname", "atom_ord").alias("resname"))
        .withColumn("letter", one_letter("resname"))
    )


def chain_sequences(atoms: DataFrame) -> DataFrame:
    """(structure_id, chain_id, chain_ord, sequence)."""
    ordered = F.array_sort(F.collect_list(F.struct("res_ord", "letter")))
    return (
        residues(atoms)
        .groupBy("structure_id", "chain_id", "chain_ord")
        .agg(F.array_join(F.transform(ordered, lambda r: r["letter"]), "").alias("sequence"))
    )


def ca_sequences(files: DataFrame) -> DataFrame:
    """(structure_id, chain_id, sequence) from CA atoms alone.

    A position (resseq, icode) counts once, whichever record comes first; residues that are not
    standard are skipped.
    """
    key = ["structure_id", "chain_id", "resseq", "icode"]
    first = (
        pdb_atom_lines(files)
        .where(F.col("atom_name") == "CA")
        .groupBy(*key)
        .agg(F.min("line_no").alias("line_no"), F.min_by("resname", "line_no").alias("resname"))
        .withColumn("letter", one_letter("resname", None))
        .where(F.col("letter").isNotNull())
    )
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "letter")))
    return first.groupBy("structure_id", "chain_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["letter"]), "").alias("sequence")
    )
