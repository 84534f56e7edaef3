"""Dimension values: ambiguity codes, genetic codes, restriction enzymes, thermodynamic parameters.

All of them are small and fixed; operators take them as DataFrames or literals.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: IUPAC nucleotide codes and the bases they stand for ---------------------------

IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT",
    "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT_FROM = "ACGTURYKMBDHVSWNacgturykmbdhvswn"
COMPLEMENT_TO = "TGCAAYRMKVHDBSWNtgcaayrmkvhdbswn"

# --- fixed values: NCBI genetic codes (id, name, amino acids, starts) ----------------------------
# Codons in NCBI's order: each base cycles T, C, A, G, the third fastest.

GENETIC_CODES = [
    (1, "Standard", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M------**--*----M---------------M----------------------------"),
    (2, "Vertebrate Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG", "----------**--------------------MMMM----------**---M------------"),
    (3, "Yeast Mitochondrial", "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**----------------------MM---------------M------------"),
    (4, "Mold Mitochondrial; Protozoan Mitochondrial; Coelenterate Mitochondrial; Mycoplasma; Spiroplasma", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--MM------**-------M------------MMMM---------------M------------"),
    (5, "Invertebrate Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG", "---M------**--------------------MMMM---------------M------------"),
    (6, "Ciliate Nuclear; Dasycladacean Nuclear; Hexamita Nuclear", "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------*--------------------M----------------------------"),
    (9, "Echinoderm Mitochondrial; Flatworm Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "----------**-----------------------M---------------M------------"),
    (10, "Euplotid Nuclear", "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**-----------------------M----------------------------"),
    (11, "Bacterial, Archaeal and Plant Plastid", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M------**--*----M------------MMMM---------------M------------"),
    (12, "Alternative Yeast Nuclear", "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**--*----M---------------M----------------------------"),
    (13, "Ascidian Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG", "---M------**----------------------MM---------------M------------"),
    (14, "Alternative Flatworm Mitochondrial", "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "-----------*-----------------------M----------------------------"),
    (15, "Blepharisma Macronuclear", "FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------*---*--------------------M----------------------------"),
    (16, "Chlorophycean Mitochondrial", "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------*---*--------------------M----------------------------"),
    (21, "Trematode Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "----------**-----------------------M---------------M------------"),
    (22, "Scenedesmus obliquus Mitochondrial", "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "------*---*---*--------------------M----------------------------"),
    (23, "Thraustochytrium Mitochondrial", "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--*-------**--*-----------------M--M---------------M------------"),
    (24, "Rhabdopleuridae Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG", "---M------**-------M---------------M---------------M------------"),
    (25, "Candidate Division SR1 and Gracilibacteria", "FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M------**-----------------------M---------------M------------"),
    (26, "Pachysolen tannophilus Nuclear", "FFLLSSSSYY**CC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**--*----M---------------M----------------------------"),
    (27, "Karyorelict Nuclear", "FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------*--------------------M----------------------------"),
    (28, "Condylostoma Nuclear", "FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**--*--------------------M----------------------------"),
    (29, "Mesodinium Nuclear", "FFLLSSSSYYYYCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------*--------------------M----------------------------"),
    (30, "Peritrich Nuclear", "FFLLSSSSYYEECC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------*--------------------M----------------------------"),
    (31, "Blastocrithidia Nuclear", "FFLLSSSSYYEECCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------**-----------------------M----------------------------"),
    (32, "Balanophoraceae Plastid", "FFLLSSSSYY*WCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M------*---*----M------------MMMM---------------M------------"),
    (33, "Cephalodiscidae Mitochondrial", "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG", "---M-------*-------M---------------M---------------M------------"),
]

# --- fixed values: restriction enzymes (name, site, top cut, bottom cut) -------------------------
# Cuts count bases from the site's start, both along the top strand.

ENZYMES = [
    ("AatII", "GACGTC", 5, 1),
    ("AccI", "GTMKAC", 2, 4),
    ("AclI", "AACGTT", 2, 4),
    ("AfeI", "AGCGCT", 3, 3),
    ("AflII", "CTTAAG", 1, 5),
    ("AgeI", "ACCGGT", 1, 5),
    ("AluI", "AGCT", 2, 2),
    ("AlwNI", "CAGNNNCTG", 6, 3),
    ("ApaI", "GGGCCC", 5, 1),
    ("ApaLI", "GTGCAC", 1, 5),
    ("AscI", "GGCGCGCC", 2, 6),
    ("AseI", "ATTAAT", 2, 4),
    ("AsiSI", "GCGATCGC", 5, 3),
    ("AvaI", "CYCGRG", 1, 5),
    ("AvrII", "CCTAGG", 1, 5),
    ("BamHI", "GGATCC", 1, 5),
    ("BbsI", "GAAGAC", 8, 12),
    ("BbvI", "GCAGC", 13, 17),
    ("BclI", "TGATCA", 1, 5),
    ("BfuAI", "ACCTGC", 10, 14),
    ("BglI", "GCCNNNNNGGC", 7, 4),
    ("BglII", "AGATCT", 1, 5),
    ("BlpI", "GCTNAGC", 2, 5),
    ("BmtI", "GCTAGC", 5, 1),
    ("BpmI", "CTGGAG", 22, 20),
    ("BsaBI", "GATNNNNATC", 5, 5),
    ("BsaHI", "GRCGYC", 2, 4),
    ("BsaI", "GGTCTC", 7, 11),
    ("BseRI", "GAGGAG", 16, 14),
    ("BsgI", "GTGCAG", 22, 20),
    ("BsiEI", "CGRYCG", 4, 2),
    ("BsiWI", "CGTACG", 1, 5),
    ("BsmBI", "CGTCTC", 7, 11),
    ("BsmI", "GAATGC", 7, 5),
    ("BspEI", "TCCGGA", 1, 5),
    ("BspHI", "TCATGA", 1, 5),
    ("BsrGI", "TGTACA", 1, 5),
    ("BssHII", "GCGCGC", 1, 5),
    ("BstAPI", "GCANNNNNTGC", 7, 4),
    ("BstBI", "TTCGAA", 2, 4),
    ("BstEII", "GGTNACC", 1, 6),
    ("BstXI", "CCANNNNNNTGG", 8, 4),
    ("BstZ17I", "GTATAC", 3, 3),
    ("Bsu36I", "CCTNAGG", 2, 5),
    ("BtgZI", "GCGATG", 16, 20),
    ("BtsI", "GCAGTG", 8, 6),
    ("ClaI", "ATCGAT", 2, 4),
    ("DpnII", "GATC", 0, 4),
    ("DraI", "TTTAAA", 3, 3),
    ("DrdI", "GACNNNNNNGTC", 7, 5),
    ("EagI", "CGGCCG", 1, 5),
    ("EarI", "CTCTTC", 7, 10),
    ("EcoNI", "CCTNNNNNAGG", 5, 6),
    ("EcoO109I", "RGGNCCY", 2, 5),
    ("EcoRI", "GAATTC", 1, 5),
    ("EcoRV", "GATATC", 3, 3),
    ("FokI", "GGATG", 14, 18),
    ("FseI", "GGCCGGCC", 6, 2),
    ("FspI", "TGCGCA", 3, 3),
    ("HaeII", "RGCGCY", 5, 1),
    ("HaeIII", "GGCC", 2, 2),
    ("HgaI", "GACGC", 10, 15),
    ("HincII", "GTYRAC", 3, 3),
    ("HindIII", "AAGCTT", 1, 5),
    ("HinfI", "GANTC", 1, 4),
    ("HpaI", "GTTAAC", 3, 3),
    ("HpaII", "CCGG", 1, 3),
    ("HpyCH4V", "TGCA", 2, 2),
    ("KasI", "GGCGCC", 1, 5),
    ("KpnI", "GGTACC", 5, 1),
    ("MboI", "GATC", 0, 4),
    ("MfeI", "CAATTG", 1, 5),
    ("MluI", "ACGCGT", 1, 5),
    ("MlyI", "GAGTC", 10, 10),
    ("MmeI", "TCCRAC", 26, 24),
    ("MscI", "TGGCCA", 3, 3),
    ("MseI", "TTAA", 1, 3),
    ("MslI", "CAYNNNNRTG", 5, 5),
    ("MspI", "CCGG", 1, 3),
    ("NaeI", "GCCGGC", 3, 3),
    ("NarI", "GGCGCC", 2, 4),
    ("NcoI", "CCATGG", 1, 5),
    ("NdeI", "CATATG", 2, 4),
    ("NgoMIV", "GCCGGC", 1, 5),
    ("NheI", "GCTAGC", 1, 5),
    ("NlaIII", "CATG", 4, 0),
    ("NotI", "GCGGCCGC", 2, 6),
    ("NruI", "TCGCGA", 3, 3),
    ("NsiI", "ATGCAT", 5, 1),
    ("NspI", "RCATGY", 5, 1),
    ("PacI", "TTAATTAA", 5, 3),
    ("PciI", "ACATGT", 1, 5),
    ("PflMI", "CCANNNNNTGG", 7, 4),
    ("PleI", "GAGTC", 9, 10),
    ("PmeI", "GTTTAAAC", 4, 4),
    ("PmlI", "CACGTG", 3, 3),
    ("PsiI", "TTATAA", 3, 3),
    ("PspXI", "VCTCGAGB", 2, 6),
    ("PstI", "CTGCAG", 5, 1),
    ("PvuI", "CGATCG", 4, 2),
    ("PvuII", "CAGCTG", 3, 3),
    ("RsaI", "GTAC", 2, 2),
    ("SacI", "GAGCTC", 5, 1),
    ("SacII", "CCGCGG", 4, 2),
    ("SalI", "GTCGAC", 1, 5),
    ("SapI", "GCTCTTC", 8, 11),
    ("Sau3AI", "GATC", 0, 4),
    ("SbfI", "CCTGCAGG", 6, 2),
    ("ScaI", "AGTACT", 3, 3),
    ("SfaNI", "GCATC", 10, 14),
    ("SfiI", "GGCCNNNNNGGCC", 8, 5),
    ("SfoI", "GGCGCC", 3, 3),
    ("SgrAI", "CRCCGGYG", 2, 6),
    ("SmaI", "CCCGGG", 3, 3),
    ("SnaBI", "TACGTA", 3, 3),
    ("SpeI", "ACTAGT", 1, 5),
    ("SphI", "GCATGC", 5, 1),
    ("SrfI", "GCCCGGGC", 4, 4),
    ("SspI", "AATATT", 3, 3),
    ("StuI", "AGGCCT", 3, 3),
    ("SwaI", "ATTTAAAT", 4, 4),
    ("TaqI", "TCGA", 1, 3),
    ("XbaI", "TCTAGA", 1, 5),
    ("XhoI", "CTCGAG", 1, 5),
    ("XmaI", "CCCGGG", 1, 5),
    ("XmnI", "GAANNNNTTC", 5, 5),
    ("ZraI", "GACGTC", 3, 3),
]

# --- fixed values: nearest-neighbour parameters (SantaLucia 1998), kcal/mol and cal/(K mol) -------

NEAREST = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2),
    "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
INIT_GC, INIT_AT, SYMMETRY_S, GAS = (0.1, -2.8), (2.3, 4.1), -1.4, 1.987
OLIGO_NM, SODIUM_MM = 500.0, 50.0
Q5_SODIUM, Q5_OLIGO = 0.15, 500e-9

# --- fixed values: sixths of a base that is G or C ------------------------------------------------

GC_SIXTHS = {"G": 6, "C": 6, "S": 6, "A": 0, "T": 0, "U": 0, "W": 0, "R": 3, "Y": 3, "K": 3, "M": 3, "B": 4, "V": 4, "D": 2, "H": 2}

CODONS = ["".join(c) for c in product("TCAG", repeat=3)]


def complement(text: str) -> str:
    return text.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))


def revcomp(text: str) -> str:
    return complement(text)[::-1]


def code_table(table: int = 1) -> dict[str, str]:
    """Amino acids by codon."""
    return dict(zip(CODONS, next(c[2] for c in GENETIC_CODES if c[0] == table), strict=True))


def enzymes(spark: SparkSession, rows: list[tuple[str, str, int, int]] | None = None) -> DataFrame:
    """(name, site, cut_top, cut_bottom, palindromic): bounded by the catalogue."""
    rows = ENZYMES if rows is None else rows
    return spark.createDataFrame([(n, s, t, b, revcomp(s) == s) for n, s, t, b in rows], "name string, site string, cut_top int, cut_bottom int, palindromic boolean")


def genetic_codes(spark: SparkSession) -> DataFrame:
    """(table_id, codon, aa, is_start)."""
    rows = [(i, c, a, s == "M") for i, _, aas, starts in GENETIC_CODES for c, a, s in zip(CODONS, aas, starts, strict=True)]
    return spark.createDataFrame(rows, "table_id int, codon string, aa string, is_start boolean")

# --- fixed values: average residue masses (Da), water, absorptivities at 280 nm ------------------

RESIDUE_MASS = {
    "A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307,
    "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766,
    "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.176, "V": 99.1326,
    "U": 150.0379, "O": 237.2982, "J": 113.1594, "B": 114.5962, "Z": 128.6231, "X": 110.0,
}
WATER = 18.01524
ABSORB_W, ABSORB_Y, ABSORB_CYSTINE = 5500, 1490, 125
POSITIVE_PK = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE_PK = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_TERMINAL_PK = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
N_TERMINAL_DEFAULT, C_TERMINAL_PK = 7.5, 3.55

# --- fixed values: guide mismatch weights, from the spacer's 5' end -------------------------------

MIT_WEIGHTS = [0, 0, 0.014, 0, 0, 0.395, 0.317, 0, 0.389, 0.079, 0.445, 0.508, 0.613, 0.851, 0.732, 0.828, 0.615, 0.804, 0.685, 0.583]

# --- fixed values: nucleases (name, PAM, PAM side, spacer length, cut on either strand) -----------

NUCLEASES = [("SpCas9", "NGG", "3prime", 20, 17, 17), ("SaCas9", "NNGRRT", "3prime", 21, 18, 18), ("AsCas12a", "TTTV", "5prime", 23, 18, 23)]
DEGENERATE_CODONS = ["NNK", "NNS", "NNN", "NDT"]

# --- fixed values: methylases (name, motif, methylated base of the top strand, of the bottom) ------
# Offsets count along the top strand of the motif.

METHYLASES = [("Dam", "GATC", 1, 2), ("Dcm", "CCWGG", 1, 3)]

# --- fixed values: methylated bases in a site that block or impair its enzyme (REBASE) -------------
# For each methylase the configurations: offsets on the top strand, offsets on the bottom strand.

METHYL_CONFIGURATIONS = {
    "AlwNI": {"Dcm": [([0], [2]), ([0, 6], [2, 8])]},
    "ApaI": {"Dcm": [([5], []), ([5], [0])]},
    "BsaBI": {"Dam": [([1], [2]), ([1, 7], [2, 8])]},
    "BsaHI": {"Dcm": [([5], [0])]},
    "BsaI": {"Dcm": [([], [0])]},
    "BspEI": {"Dam": [([5], []), ([5], [0])]},
    "BspHI": {"Dam": [([5], []), ([5], [0])]},
    "BstXI": {"Dcm": [([1], [10])]},
    "ClaI": {"Dam": [([0], [1]), ([0, 4], [1, 5])]},
    "EcoO109I": {"Dcm": [([5], []), ([5], [0]), ([5], [1])]},
    "FokI": {"Dcm": [([], [0])]},
    "FseI": {"Dcm": [([7], [0])]},
    "MboI": {"Dam": [([1], [2])]},
    "MscI": {"Dcm": [([4], []), ([4], [1])]},
    "NruI": {"Dam": [([5], []), ([5], [0])]},
    "PflMI": {"Dcm": [([1], []), ([1], [9])]},
    "SfiI": {"Dcm": [([3], []), ([3, 12], []), ([3], [0]), ([3, 12], [0])]},
    "SfoI": {"Dcm": [([5], [0])]},
    "StuI": {"Dcm": [([4], []), ([4], [1])]},
    "TaqI": {"Dam": [([3], []), ([3], [0])]},
    "XbaI": {"Dam": [([5], []), ([5], [0])]},
}
#: Enzymes for which any methylated base of the methylase in the site counts.
METHYL_ANY = {"BclI": ["Dam"], "DpnII": ["Dam"], "FspI": ["Dam", "Dcm"]}

# --- fixed values: base editors (name, base, what it becomes, window in the spacer from 1) ---------

BASE_EDITORS = [("CBE", "C", "T", 4, 8), ("ABE7.10", "A", "G", 4, 7), ("ABE8e", "A", "G", 4, 8)]

#: BLOSUM62 (Henikoff and Henikoff 1992), the lower triangle, a row for each residue.
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
RESIDUES = "".join(line.split()[0] for line in BLOSUM62.strip().splitlines())

#: Free energies (kcal/mol, 37 degrees) of loops by size (SantaLucia and Hicks 2004, table 4).
HAIRPIN_LOOPS = {3: 3.5, 4: 3.5, 5: 3.3, 6: 4.0, 7: 4.2, 8: 4.3, 9: 4.5, 10: 4.6, 12: 5.0, 14: 5.1, 16: 5.3, 18: 5.5, 20: 5.7, 25: 6.1, 30: 6.3}
BULGES = {1: 4.0, 2: 2.9, 3: 3.2, 4: 3.3, 5: 3.5, 6: 3.7}
INTERIOR_LOOPS = {3: 3.2, 4: 3.6, 5: 4.0, 6: 4.4}
