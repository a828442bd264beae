import os

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"
TABLES = ("candidates", "checkpoints", "code_pairs", "combined_block_metrics", "source_files", "function_manifest", "documents", "heldout_items", "mix_targets", "split_targets")
#: Names that the operators use inside.
CLASHES = ("key", "doc", "text2", "n", "digest", "cell", "unit", "class", "kind", "file", "label", "score", "split2", "begin", "x", "group_line_no", "pair_id", "tokens", "component", "node", "block")


def write(folder, tables):
    for name, t in tables.items():
        pq.write_table(t, folder / f"{name}.parquet")
    return str(folder)


def load():
    if not os.path.isdir(SMALL):
        pytest.skip("the driver's tables aren't here")
    return {n: ds.dataset(f"{SMALL}/{n}.parquet").to_table() for n in TABLES}


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), {n: t.slice(0, 0) for n, t in load().items()})


@pytest.fixture(scope="session")
def plain_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("plain"), load())


@pytest.fixture(scope="session")
def dirty_dir(tmp_path_factory):
    """The plain tables with every row twice, rows of nulls, a text of nothing and a very long one, and clashing columns."""
    out = {}
    for name, t in load().items():
        empty = pa.Table.from_pylist([{c: None for c in t.column_names}] * 2, schema=t.schema)
        rows = t.slice(0, 1).to_pylist()
        extra = []
        for text in ("", " \n\t", "(" * 3000 + "word " * 60000 + "/*" * 3000, "a" * 200000):
            row = dict(rows[0])
            for c in row:
                if c in ("code", "agc_code", "raw_output", "clean_output", "file_text", "text", "solution"):
                    row[c] = text
                if c in ("line_no", "doc_id", "item_id", "manifest_row_number"):
                    row[c] = 900_000 + len(extra)
                if c in ("idx", "relative_path"):
                    row[c] = f"extra{len(extra)}_human" if c == "idx" else f"src/extra{len(extra)}.py"
            extra.append(row)
        keep = name in ("mix_targets", "split_targets", "combined_block_metrics", "heldout_items")
        parts = [t, empty] if keep else [t, t, empty, pa.Table.from_pylist(extra, schema=t.schema)]
        whole = pa.concat_tables(parts)
        for c in CLASHES:
            if c not in whole.column_names:
                whole = whole.append_column(c, pa.array(["clash"] * whole.num_rows))
        out[name] = whole
    return write(tmp_path_factory.mktemp("dirty"), out)
