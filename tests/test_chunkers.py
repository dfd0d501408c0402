import pytest

from locusframe.operators import chunkers


def by_id(chunks):
    return {row.id: row for row in chunks.collect()}


def peaks(n, groups=("1", "2"), genes=5):
    return [
        dict(gene_symbol=f"g{i % genes}", gene_type=f"t{i % 2}", qtl_chr=groups[i % len(groups)],
             qtl_pos=float((i * 7) % 31), qtl_lod=float((i * 13) % 23), qtl_pval=0.5, cis=i % 2 == 0)
        for i in range(n)
    ]


def test_missing_groups_and_names_are_left_out(make_records):
    df = make_records(
        [dict(qtl_chr="1", gene_symbol="a", qtl_lod=1.0), dict(gene_symbol="b"), dict(qtl_chr="1", qtl_lod=2.0)]
    )
    assert set(by_id(chunkers.chunk_by_gene(df))) == {"gene_a", "gene_b"}
    chunk = by_id(chunkers.chunk_by_chromosome(df))["chr_1_part_1"]
    assert chunk.metadata.qtl_count == 2
    assert chunk.metadata.genes == ["a"]
    assert chunk.content.startswith("QTL findings on chromosome 1 (positions nan-nan Mb):\n\n")


def test_scores_without_value_have_no_tier(make_records):
    df = make_records([dict(qtl_lod=None), dict(qtl_lod=10.0), dict(qtl_lod=9.99), dict(qtl_lod=0.0)])
    chunks = by_id(chunkers.chunk_by_significance(df))
    assert chunks["high_sig_qtls_part_1"].metadata.qtl_count == 1
    moderate = chunks["mod_sig_qtls_part_1"]
    assert [r.row_id for r in moderate.raw_data] == [2, 3]
    assert moderate.content.startswith("Moderate significance QTLs (LOD < 10.0):\n\nGene: nan")


def test_rank_end_is_not_limited_by_the_rows(make_records):
    chunks = by_id(chunkers.chunk_top_records(make_records(peaks(30))))
    assert set(chunks) == {"top_qtls_1_25", "top_qtls_26_50"}
    assert chunks["top_qtls_26_50"].metadata.qtl_count == 5


@pytest.mark.parametrize("rows_per_task", [1_000_000, 10])
def test_blocks_cover_every_record_once(make_records, rows_per_task):
    df = make_records(peaks(95))
    for chunks, size in [
        (chunkers.chunk_by_chromosome(df, 20, rows_per_task=rows_per_task), 20),
        (chunkers.chunk_by_genomic_regions(df, 7, rows_per_task=rows_per_task), 7),
        (chunkers.chunk_by_significance(df, 12.0, 5, rows_per_task=rows_per_task), 10),
        (chunkers.chunk_by_gene_pathways(df, 2, rows_per_task=rows_per_task), 95),
    ]:
        rows = chunks.collect()
        assert all(len(r.raw_data) == r.metadata.qtl_count <= size for r in rows)
        assert sorted(x.row_id for r in rows for x in r.raw_data) == list(range(95))
        assert len({r.id for r in rows}) == len(rows)


def test_sorted_and_windowed_chunks_are_equal(make_records):
    df = make_records(peaks(95))
    for chunker in (chunkers.chunk_by_chromosome, chunkers.chunk_by_genomic_regions):
        plain = by_id(chunker(df, 9))
        assert by_id(chunker(df, 9, rows_per_task=10)) == plain


def test_long_groups_continue_in_parts(make_records):
    df = make_records(peaks(50, genes=1) + [dict(gene_symbol="rare", qtl_lod=1.0)])
    chunks = by_id(chunkers.chunk_by_gene(df, max_records=20, rows_per_task=10))
    assert set(chunks) == {"gene_g0", "gene_g0_part_2", "gene_g0_part_3", "gene_rare"}
    assert [x.row_id for x in chunks["gene_g0_part_2"].raw_data] == list(range(20, 40))
    sets = by_id(chunkers.chunk_by_gene_pathways(df, max_records=30, rows_per_task=10))
    assert set(sets) == {"gene_set_1", "gene_set_1_part_2"}
    assert [c.metadata.qtl_count for c in sets.values()] == [51, 51]
    assert sum(len(c.raw_data) for c in sets.values()) == 51
    lods = [x.qtl_lod for x in sorted(sets["gene_set_1"].raw_data, key=lambda x: -x.qtl_lod)]
    assert min(lods) >= max(x.qtl_lod for x in sets["gene_set_1_part_2"].raw_data)


def test_gene_chunk_text_and_metadata(make_records):
    df = make_records(
        [
            dict(gene_symbol="a", gene_type="x", qtl_chr="2", qtl_lod=1.0),
            dict(gene_symbol="a", gene_type="y", qtl_chr="1", qtl_lod=3.0),
            dict(gene_symbol="a", gene_type="y", qtl_chr="2"),
        ]
    )
    chunk = by_id(chunkers.chunk_by_gene(df))["gene_a"]
    assert chunk.metadata.chromosomes == ["2", "1"]
    assert (chunk.metadata.gene_type, chunk.metadata.max_lod) == ("x", 3.0)
    assert chunk.content.startswith("QTL findings for gene a:\n\nGene: a | LOD Score: 1.0")
    assert chunk.content.count("\n\n") == 3


def test_missing_columns_take_defaults(make_records):
    df = make_records([dict(gene_symbol="a")]).select("row_id", "gene_symbol")
    meta = chunkers.chunk_by_row(df).first().metadata
    assert (meta.gene_symbol, meta.qtl_lod, meta.qtl_chr, meta.qtl_pval, meta.cis, meta.gene_type) == (
        "a", 0.0, "Unknown", 1.0, False, "Unknown",
    )


def test_every_part_tells_of_the_whole_gene(make_records):
    rows = [dict(gene_symbol="a", qtl_chr=str(i % 3 + 1), gene_type=f"t{i}", qtl_lod=float(i)) for i in range(12)]
    rows.append(dict(gene_symbol="b", qtl_lod=1.0))
    chunks = chunkers.chunk_by_gene(make_records(rows), max_records=5).orderBy("id").collect()
    assert [c.id for c in chunks] == ["gene_a", "gene_a_part_2", "gene_a_part_3", "gene_b"]
    for part, c in enumerate(chunks[:3], 1):
        m = c.metadata
        assert (m.qtl_count, m.max_lod, m.chromosomes, m.gene_type, m.part, m.parts) == (12, 11.0, ["1", "2", "3"], "t0", part, 3)
    sets = chunkers.chunk_by_gene_pathways(make_records(rows), max_records=5).collect()
    assert len(sets) == 3
    for c in sets:
        assert "Gene set 1: 2 genes with 13 QTLs" in c.content and c.metadata.qtl_count == 13
    assert sum(len(c.raw_data) for c in sets) == 13


def test_chunk_files_that_are_one_array(spark, make_records, tmp_path):
    from locusframe.sources.chunks import read_chunks_json

    record = make_records([dict(gene_symbol="a")]).schema
    (tmp_path / "c.json").write_text(
        '[{"id": "x", "type": "single_qtl", "content": "c", "metadata": {"qtl_lod": NaN, "lod_range": [NaN, 2.0]},'
        ' "raw_data": {"gene_symbol": "a", "qtl_lod": NaN}},\n {"id": "y", "type": "gene_group", "content": "d",'
        ' "metadata": {"qtl_lod": 3.0}, "raw_data": [{"gene_symbol": "a", "qtl_lod": 1.5}, {"gene_symbol": "b"}]}]'
    )
    x, y = read_chunks_json(spark, f"file://{tmp_path}/c.json", record, array_file=True).orderBy("id").collect()
    assert (x.metadata.qtl_lod, x.metadata.lod_range, x.raw_data[0].gene_symbol, x.raw_data[0].qtl_lod) == (None, [None, 2.0], "a", None)
    assert [(r.gene_symbol, r.qtl_lod) for r in y.raw_data] == [("a", 1.5), ("b", None)]


def test_parts_have_ids_of_their_own(make_records):
    """A gene may be called like the part of another one."""
    rows = [dict(gene_symbol="X", qtl_lod=1.0)] * 25 + [dict(gene_symbol="X_part_2", qtl_lod=1.0)] * 3 + [dict(gene_symbol="Y")]
    ids = [r.id for r in chunkers.chunk_by_gene(make_records(rows), max_records=10).collect()]
    assert sorted(ids) == ["gene_X", "gene_X_part_2", "gene_X_part_2_part_1", "gene_X_part_3", "gene_Y"]
    ids = [r.id for r in chunkers.chunk_by_gene(make_records(rows[24:]), max_records=10).collect()]
    assert sorted(ids) == ["gene_X", "gene_X_part_2", "gene_Y"]
