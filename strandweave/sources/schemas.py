"""Column types of the formats."""

from __future__ import annotations

FASTX = "name string, comment string, seq string, qual string"
SFS = (
    "flag int, rname string, s int, l int, e int, sv bigint, ev bigint, soff int, eoff int, gfa_sv string, gfa_ev string, "
    "skmer bigint, ekmer bigint, paths array<bigint>, seq string"
)
GAF = (
    "qname string, qlen bigint, qs bigint, qe bigint, strand string, path string, plen bigint, ps bigint, pe bigint, "
    "matches bigint, cigar_len bigint, mapq int, tags map<string,string>"
)
SEGMENTS = "id string, seq string, tags map<string,string>"
LINKS = "v1 string, s1 string, v2 string, s2 string, overlap string"
WALKS = "sample string, hap int, contig string, start bigint, end bigint, walk array<struct<id:string,rev:boolean>>"
PATHS = "name string, steps array<struct<id:string,rev:boolean>>, overlaps string"
SAM = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags map<string,string>"
BED = "chrom string, s bigint, e bigint, info string"
FAI = "chrom string, length bigint"
VCF = "chrom string, pos bigint, id string, ref string, alt string, qual string, filter string, info string"
SKETCH = "kmer bigint, v1 bigint, rev1 boolean, v2 bigint, rev2 boolean, pos1 int, pos2 int, has_both boolean, is_ref boolean"
SUPPORT = "tool string, n int, coverage int, clen int, kind string, v string, l string, supp int, qual double"
NM = "tool string, n int, coverage int, clen int, read string, cov double, nm int, type string"
CORRECTNESS = "n int, Graph string, d double, w int, Consensus string, Length int, AlType string, NM int, M int, X int, I int, D int, NV int, NB int"
ASSEMBLY = "Sample string, Coverage string, Aligner string, RName string, NM int, Length int, Clipped int"
ANCHORING = "qname string, s int, e int, v1 string, v2 string, true1 string, true2 string, category string"
