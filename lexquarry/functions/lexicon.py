"""Word lists and patterns that decide results."""

# Results are right only with exactly these.

#: Cues of a statement on where data can be found.
AVAILABILITY_CUES = [
    "data availability", "data availability statement", "availability of data", "data are available", "data will be available",
    "dataset is available", "deposited in", "available upon request", "upon reasonable request", "accession", "repository",
    "zenodo", "figshare", "dryad", "geo", "gse", "sra", "ebi", "arrayexpress", "pdb", "uniprot",
    "deposited", "downloaded", "accessed", "retrieved", "obtained", "collected", "gathered", "sourced", "extracted", "acquired",
    "database", "databank", "archive", "portal", "ncbi", "ensembl", "genbank", "embl", "ddbj", "ena", "pride", "metabolights", "mendeley", "osf",
    "identifier", "pmid", "pmcid", "srp", "srr", "prj", "sam", "biosample", "bioproject", "accession number", "dataset id", "study id",
    "dataset", "supplementary data", "raw data", "processed data",
]

#: Sections and the cues that show them, in the order in which they are tried.
SECTION_CUES = {
    "data availability": ["data availability", "availability of data"],
    "methods": ["methods", "materials and methods", "experimental procedures"],
}

#: Families of accession numbers that are counted.
ACCESSIONS = {
    "geo_gse": r"\bGSE\d+\b",
    "sra_run": r"\bSRR\d+\b",
    "sra_generic": r"\bSRA\d+\b",
    "ena_bioproject": r"\bPRJ\w+\d+\b",
    "arrayexpress": r"\bE-\w+\-\d+\b",
    "pdb": r"\bPDB\s?[0-9][A-Za-z0-9]{3}\b",
    "uniprot": r"\b[OPQ][0-9][A-Z0-9]{3}[0-9]\b",
    "chembl": r"\bCHEMBL\d+\b",
    "gisaid": r"\bEPI_ISL_\d+\b",
}

#: Tight identifier patterns; a text's score counts how many of them occur.
SPECIFIC = {
    "gisaid": r"\bEPI(?:_ISL)?_?\d+\b",
    "geo_gse": r"\bGSE\d+\b",
    "sra_run": r"\bSRR\d+\b",
    "sra_experiment": r"\bSRX\d+\b",
    "sra_study": r"\bSRP\d+\b",
    "sra_sample": r"\bSRS\d+\b",
    "ena_bioproject": r"\bPRJ[A-Z]+\d+\b",
    "ena_run": r"\b[ED]RR\d+\b",
    "ena_experiment": r"\b[ED]RX\d+\b",
    "ena_sample": r"\b[ED]RS\d+\b",
    "ena_biosample": r"\bSAM[A-Z]?\d+\b",
    "arrayexpress": r"\bE-\w+-\d+\b",
    "pdb": r"\b[0-9][A-Za-z0-9]{3}\b",
    "uniprot": r"\b(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9][A-Z0-9]{3}[0-9])\b",
    "interpro": r"\bIPR\d{6}\b",
    "pfam": r"\bPF\d{5}\b",
    "pfam_clan": r"\bCL\d{4}\b",
    "chembl": r"\bCHEMBL\d+\b",
    "kegg_ko": r"\bK\d{5}\b",
    "ensembl_gene": r"\bENS\w*\d+\b",
    "cellosaurus": r"\bCVCL_\w{4}\b",
    "empiar": r"\bEMPIAR-\d+\b",
    "pride_pxd": r"\bPXD\d+\b",
    "pride_prd": r"\bPRD\d+\b",
    "ncbi_refseq": r"\b[A-Z]{2}_\d+(?:\.\d+)?\b",
    "dbsnp": r"\brs\d+\b",
    "hgnc": r"\bHGNC:\d+\b",
    "kegg_pathway": r"\bmap\d{5}\b",
}
SPECIFIC_ENOUGH = 3

#: DOIs of data repositories, and the repositories' names.
REPOSITORY_DOIS = {
    "figshare_doi": r"https?://doi\.org/10\.6084/(?:m9\.figshare\.|figshare\.)\S+",
    "dryad_doi": r"https?://doi\.org/10\.5061/dryad\.\S+",
    "zenodo_doi": r"https?://doi\.org/10\.5281/zenodo\.\S+",
    "pangaea_doi": r"https?://doi\.org/10\.1594/pangaea\.\S+",
    "mendeley_doi": r"https?://doi\.org/10\.(?:17632|18150)/\S+",
    "ccdc_doi": r"https?://doi\.org/10\.5517/\S+",
    "tcia_doi": r"https?://doi\.org/10\.7937/tcia\.\S+",
    "pasta_doi": r"https?://doi\.org/10\.6073/pasta-\S+",
}
REPOSITORY_NAMES = ["figshare", "dryad", "zenodo", "pangaea", "mendeley", "ccdc", "tcia", "pasta"]

#: Keyword categories with their weights: for training ...
CATEGORY_WEIGHTS = {"access_verbs": 0.15, "repositories": 0.20, "identifiers": 0.15, "data_terms": 0.10}
TRAINING_KEYWORDS = {
    "access_verbs": ["deposited", "downloaded", "accessed", "retrieved", "obtained", "collected", "gathered", "sourced", "extracted", "acquired"],
    "repositories": [
        "repository", "database", "databank", "archive", "portal", "ncbi", "uniprot", "ensembl", "genbank", "embl", "ddbj",
        "geo", "arrayexpress", "sra", "ena", "pride", "metabolights", "figshare", "zenodo", "dryad", "mendeley", "osf"],
    "identifiers": [
        "accession", "identifier", "doi", "pmid", "pmcid", "gse", "srp", "srr", "prj", "sam", "biosample", "bioproject",
        "accession number", "dataset id", "study id"],
    "data_terms": [
        "dataset", "data", "supplementary data", "raw data", "processed data", "transcriptome", "proteome", "genome", "metabolome",
        "microarray", "rna-seq", "chip-seq", "mass spectrometry", "sequencing data"],
}
TRAINING_CITED, TRAINING_CAP = 0.20, 0.5
#: ... and for inference.
INFERENCE_KEYWORDS = {
    "access_verbs": ["deposited", "accessed", "retrieved", "obtained", "collected", "gathered", "sourced", "extracted", "acquired"],
    "repositories": TRAINING_KEYWORDS["repositories"],
    "identifiers": [
        "accession", "identifier", "pmid", "pmcid", "gse", "srp", "srr", "prj", "sam", "biosample", "bioproject",
        "accession number", "dataset id", "study id"],
    "data_terms": [
        "dataset", "supplementary data", "raw data", "processed data", "transcriptomics data", "proteomics data", "genomics data",
        "metabolomics data", "microarray data", "rna-seq data", "chip-seq data", "mass spectrometry data", "sequencing data"],
}
INFERENCE_CAP = 0.80

#: Weights of the fused score, and its neighbour boost.
FUSION = {"prototype": 0.70, "rrf": 0.10, "das": 0.10, "regex": 0.05, "doi_repo": 0.05}
NEIGHBOUR_STEP, NEIGHBOUR_CAP = 0.02, 0.05

#: Words that add to a query for data citations.
QUERY_ACCESSIONS = ["accession", "GSE", "SRA", "SRR", "ArrayExpress", "ENA", "BioProject", "PDB", "GISAID", "Zenodo", "Dryad", "Figshare", "GEO", "Deposition number", "SRA"]
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "

#: Strings of examples that must not come back as citations.
EXAMPLE_CITATIONS = [
    "E-GEOD-48278", "JX312727", "PRJNA384940", "https://doi.org/10.5061/dryad.4dj6042", "10.5061/dryad.4dj6042", "doi:10.5061/dryad.4dj6042",
    "https://doi.org/10.6084/m9.figshare.29901470.v1", "https://doi.org/10.15468/dl.354f8k", "JX312727-JX312728", "JX312728"]

#: Section types by name, and by title; the first match counts.
SECTION_TYPES = {
    "abstract": "abstract", "introduction": "introduction", "background": "introduction",
    "method": "methods", "methods": "methods", "methodology": "methods", "materials": "methods", "materials and methods": "methods",
    "experimental": "methods", "procedure": "methods", "data and methods": "methods",
    "results": "results", "result": "results", "findings": "results", "results and discussion": "results",
    "discussion": "discussion", "conclusion": "conclusion", "conclusions": "conclusion", "summary": "conclusion",
    "availability": "data_availability", "data availability": "data_availability", "data_availability": "data_availability", "code availability": "data_availability",
    "acknowledgment": "acknowledgments", "acknowledgement": "acknowledgments", "acknowledgements": "acknowledgments",
    "references": "references", "bibliography": "references", "funding": "funding", "author": "author_info", "authors": "author_info",
    "conflict": "conflicts", "conflicts": "conflicts", "competing interests": "conflicts", "ethics": "ethics",
    "supplementary": "supplementary", "supplement": "supplementary", "appendix": "appendix", "appendices": "appendix",
}
TITLE_PATTERNS = {
    "abstract": r"abstract",
    "introduction": r"(background|introduction)",
    "methods": r"(methods?|methodology|materials?\s+and\s+methods?|experimental\s+(procedure|design|methods?)|procedure)",
    "results": r"(results?|findings)",
    "discussion": r"discussion",
    "conclusion": r"(conclus(?:ion|ions)|summary)",
    "data_availability": r"(data\s+availability|data\s+&\s+code\s+availability|code\s+availability|availability\s+of\s+data)",
    "acknowledgments": r"acknowledgm(?:ent|ents)",
    "references": r"(references?|bibliography)",
    "funding": r"funding",
    "author_info": r"(author|authors)(\s+(information|details|contributions?))?",
    "conflicts": r"(conflict|conflicts|competing\s+interests)",
    "ethics": r"(ethics|ethical\s+(approval|statement))",
    "supplementary": r"(supplementary|supplement)",
    "appendix": r"(appendix|appendices)",
}
CAPTION_WORDS = ["figure", "fig.", "table", "caption"]

#: Families of identifiers: their shape, other spellings of them, and what a tolerant pattern is made of: ("letters", group)
#: is spaced out letter by letter, ("digits", group) is as many digits, anything else is a pattern itself (GAP: blanks and dashes).
GAP = "[\\s\u00a0\\-\u2010-\u2015]*"
SOFT = "[\\s\u00a0\\-\u2010-\u2015_,.]*"
BETWEEN = "[\\s\u00a0\\-\u2010-\u2015_/:.,]*"
FAMILIES = [
    ("(?i)^E-GEOD-(\\d+)$", ["GSE$1"], None),
    ("(?i)^(PXD|SRR|ERR)(\\d+)$", ["$1-$2", "$1 $2"], [("letters", 1), GAP, ("digits", 2)]),
    ("(?i)^E-?(PROT)-?(\\d+)$", ["E-PROT-$2", "E PROT $2", "EPROT$2"], ["E", GAP, ("letters", 1), GAP, "-?", GAP, ("digits", 2)]),
    ("(?i)^(ENS)([A-Z]+)(\\d+)$", ["$1-$2-$3", "$1 $2 $3"], [("letters", 1), GAP, ("letters", 2), GAP, ("digits", 3)]),
    ("(?i)^([A-Z0-9]{2,6})(\\d{3,})$", ["$1-$2", "$1 $2"], [("letters", 0)]),
    ("(?i)^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9])(?:[A-Z0-9]{3}[0-9])?$", [], [("letters", 0)]),
]
#: A prefix and a number, as ranges and lists have them; where a list ends, and how far it is followed.
HEADED = "(?i)^\\s*([A-Z]{2,10})[\\s\u00a0\\-\u2010-\u2015_]*([0-9]{3,})\\s*$"
LIST_END, LIST_REACH = "[.;](?:\\s|$)", 300

#: Entities by kind: a text of this form, any case, between characters that are no letters, digits or underscores.
ENTITIES = {
    "DOI": r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+",
    "GEO_Series": r"GSE\d{3,6}",
    "GEO_Sample": r"GSM\d{3,8}",
    "SRA_Run": r"SRR\d{6,}",
    "PDB_ID": r"[0-9][A-Za-z0-9]{3}",
    "PDB_DOI": r"10\.2210/pdb[0-9][A-Za-z0-9]{3}/pdb",
    "ArrayExpress": r"E\-[A-Z]{3,6}\-\d+",
    "dbGaP": r"phs\d{6}(?:\.\d+)?(?:\.p\d+)?",
    "TCGA": r"TCGA\-[A-Z0-9]{2}\-[A-Z0-9]{4}(?:\-[A-Z0-9\-]+)?",
    "ENA_Project": r"PRJ[EDN][A-Z]\d{4,}",
    "ENA_Study": r"ERP\d{6,}",
    "ENA_Sample": r"SAM[EDN][A-Z]?\d{5,}",
    "SRA_Experiment": r"SRX\d{6,}",
    "SRA_Project": r"SRP\d{6,}",
    "SRA_Sample": r"SRS\d{6,}",
    "SRA_Study": r"SRA\d{5,}",
    "RefSeq_Chromosome": r"NC_\d{6,9}(?:\.\d+)?",
    "ENA_Run": r"ERR\d{6,}",
    "ENA_Experiment": r"ERX\d{6,}",
    "ENA_Sample2": r"ERS\d{6,}",
    "DDBJ_Run": r"DRR\d{6,}",
    "DDBJ_Experiment": r"DRX\d{6,}",
    "ENCODE_Assay": r"ENCSR[0-9A-Z]{6}",
    "PRIDE": r"PXD\d{6,}",
    "WIKIDATA": r"(?:Q|P|E|L)\d{1,8}",
    "OCID": r"\d{12}",
    "DOID": r"DOID:\d{4,7}",
    "ChEMBL": r"CHEMBL\d{4,7}",
    "InterPro": r"IPR\d{6}",
    "Pfam": r"PF\d{5}(?:\.\d+)?",
    "UniProt": r"(?:[A-NR-Z][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]{4}[A-Z0-9]{5})",
    "CATH": r"\d+\.\d+\.\d+\.\d+",
    "KEGG": r"K\d{5}",
    "dbSNP": r"rs\d{3,}",
    "Ensembl": r"ENS[A-Z]{0,5}[GTRP]\d{11}(?:\.\d+)?",
    "RefSeq_mRNA": r"NM_\d{6,}(?:\.\d+)?",
    "RefSeq_Protein": r"NP_\d{6,}(?:\.\d+)?",
    "RefSeq_Genome": r"[A-Z]{2}_\d{6,}(?:\.\d+)?",
    "GenBank": r"[A-Z]{1,2}\d{5,8}(?:\.\d+)?",
    "DDBJ": r"D\d{5}(?:-\d+)?(?:\.\d+)?",
    "GISAID": r"EPI_ISL_\d{6,}",
    "EMPIAR": r"EMPIAR-\d{5,}",
    "ExpressionAtlas": r"E\-PROT\-\d+",
    "BioModels": r"MODEL\d{10,13}",
    "HPA_Antibody": r"HPA\d{6}",
    "CAB_Antibody": r"CAB\d{6}",
    "Cellosaurus": r"CVCL_[A-Z0-9]{4,}",
}
