"""Patterns and word lists of the text operators (fixed values), and the predicates over them.

All are Java patterns for the JVM's regex functions. ``(?U)`` makes word
boundaries and blanks those of Unicode.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BINOMIAL = r"(?U)\b([A-Z][a-z]{2,})\s+([a-z]{4,})\b"
GENUS = r"(?U)\b([A-Z][a-z]{2,})\b"
DRAWING_BINOMIAL = r"(?U)\b([A-Z][a-z]{3,})\s+([a-z]{4,})\b(?!-)"
RESOLVED_BINOMIAL = r"(?U)\b([A-Z][a-z]{2,20})\s+([a-z][a-z\-]{2,25})\b"
NAME_IN_FILE = r"(?U)__([A-Za-z][a-z]{2,})_([a-z]{3,}|sp)(?:\.[A-Za-z]+)?$"
LEGEND_STRICT = r"(?mU)(?:^|[.;]\s*|,\s+)(\d{1,3})\s*[.)\-–:]\s*([A-Z][a-z]{2,20})\s+([a-z][a-z\-]{2,25})"
LEGEND_LOOSE = r"(?U)(\d{1,3})\s*[.,:)\-–]\s*([A-Z][a-z]{2,20})\s+([a-z][a-z\-]{2,25})"
FIGURE_CAPTION = r"(?isU)(?:Figs?\.?|Figures?|Plate|Prancha)\s*[\d.,\-–\s]+[.:\-–]\s*(.+)"
CAPTION_PAIRS = r"(?U)(\d{1,3})\s*[.,;:)\-–]\s*([A-Z][a-z]{2,20})\s+([a-z][a-z\-]{2,25})"
ABBREVIATED = r"(?U)(\d{1,3})\s*[.,;:)\-–]\s*([A-Z])\.\s*([a-z][a-z\-]{2,25})"
FIGURE_START = r"(?iU)^(fig|figure|figura|plate|prancha)"
BLOCKED_SECTION = (
    r"(?iU)(?:^|\n)\s*(?:material\s+examined|material\s+examinado|acknowledgements?|acknowledgments?|agradecimentos"
    r"|etymology|etimologia|specimens?\s+examined|holotype\s*:|holotipo\s*:|isotype\s*:|isotipo\s*:)"
)
TREE_CAPTION = (
    r"(?iU)\b(?:phylo(?:gram|genet|tree|genetic)|ML\s+tree|RAxML|neighbor[\s\-]joining|parsimony|cladogram|dendrogram"
    r"|maximum\s+likelihood|bayesian|phylogenetic|multi[\s\-]locus|concatenat|bootstrap\s+support|molecular\s+clock|divergence\s+time)\b"
)
MICROSCOPY_CAPTION = (
    r"(?iU)\b(?:colon(?:y|ies)|conidi(?:a|um|ophore|óforo|oforo)|spore[s]?|microscop|lamina|morpholog|hyphae?|ascomat|peridium"
    r"|submerged|aquatic|lignicol|holotype|fruiting|sporulat|setae?|stroma|chlamydospore|germina)\b"
)
NOISE_KEYWORDS = ("licensee mdpi", "copyright", "all rights reserved", "universidade estadual", "nrc canada", "open access", "creative commons", "license")
NOT_A_GENUS_SUFFIX = ("aceae", "ales", "idae", "inae", "oideae", "mycota", "mycetes", "ing", "tion", "sion", "ment", "ness", "less", "ance", "ence", "ical", "ular", "ious", "eous", "able")

#: Words that are no epithets (fixed values).
NOT_EPITHETS = tuple(
    """figure figura figures figuras plate prancha plates chave chaves clave genus species specie generos conidia conidio
    conidios conidium mycelium mycelia substratum substrato habitat ecology ecologia descripcion description descricao type
    typus tipo note nota notes notas photo photos foto fotos scale escala based according following preceding growing
    producing collected isolated observed studied water stream river leaf leaves litter wood bark them they their there
    these those this that with from also only each both some many most more less used were have been than when then tree
    data gene genes locus loci taxa taxon clade clades node nodes which while after given using found known show such very
    even just thus other into onto upon over under shown among around about above below within without between through
    against during along across analysis support values bootstrap""".split()
)
#: Capitalised words that are no genera (fixed values).
NOT_GENERA = tuple(
    """Fig Figure Figura Plate Prancha Clave Chave Table Tabela Note Nota The This That These Those Conidia Conidium Conidio
    Conidios Leaf Stream Water River Scale Bar Family Familia Genus Species Order Class Kingdom January February March April
    May June July August September October November December Among Based Using Which While After Before During Within
    Without Between Through Against Around About Above Below Under Over Into Onto Upon With From Also Only Both Each Most
    Some Many More Less Such Very Well Just Even Thus Then When Here There Where All Any New Old One Two Three Four Five Six
    Seven Eight Nine Ten Since However Therefore Moreover Furthermore Although Bootstrap Maximum Bayesian Parsimony Analysis
    Combined Concatenated Topology Phylogram Cladogram Support Values Matrix Dataset""".split()
)
#: Capitalised words of four letters and more, without a suffix of other ranks or words, that are no genera in legends (fixed values).
NOT_LEGEND_GENERA = tuple(
    """Figure Plate Appendix Species Genus Family Order Class Phylum Kingdom Author Study Results Methods Abstract References
    Notes Scale Figs Supplementary Material Supplemental This These Their From With Also Such Both Some Many Most Other
    Each Type Were Have Should Would Could Does Been Into Over Under After Before Between Within However Therefore
    Furthermore Moreover Although Based Used Among Along Around Upon Respectively Previously Combined Shown Given Found
    Known Made Note Taxonomy Systematics Phylogeny Phylogenetic Morphology Analysis Analyses Isolates Isolate Strains
    Strain Cultures Culture Fungal Fungus Fungi European American Brazilian Asian African Australian North South East West
    Central Upper Lower Novel Unknown Undescribed Sexual Asexual Collections Specimen Specimens Voucher Generic Similar
    Different Present Recent Current Several Multiple Single Large Small Long Short Wide Narrow Dark Light White Black
    Hyaline Septate Branched Simple Complex Common Rare Frequent Abundant Diverse Important Distinct Unique Characteristic
    Spores Conidia Conidial Sample Samples Colonies Colony Conidiophores Mycelium Hyphae Average General Download
    Downloaded Biotic Parasitic Saprophytic Heterotrophic Despite While Content Minimum Maximum Article History Academic
    Editor Open Source Image Data Bootstrap Neighbour Relationship Configured Solutions Cluster Monthly Variations Nickel
    Sorensen Pooled Mere Exposure Substantive Springer Successful Primer Major Milestones Conjugate Ingoldian Ingold
    Microscopic Structures Blue Periascal Immature Newly Generated Products Pubs Kappa Values Mosaic When Here Only
    Incertae Sedis Even Though Total Number Dimethyl Phthalate World Cladogram Phylogram Practices Seven Nannfeldt Erected
    Foot Cells Parsimony Emended Forest Haridwar River Asan Wetland Limnology Environmental Esta Este Para Como Mais Foram
    Sendo Ainda""".split()
)
#: Words that are no epithets in legends (fixed values).
NOT_LEGEND_EPITHETS = tuple(
    """and the was were are for from with had has have been not but can may data into also such which when than recognized
    pubs values issue number showed during between species growing typically effuse reduced cells body elements axis
    branches conidia fungi interactions structures milestones formation chemical exposure difference matches variations
    analysis solutions history editor source practices""".split()
)
#: Genera of the built-in vocabulary (fixed values).
BUILT_IN_GENERA = tuple(
    """Actinospora Alatospora Articulospora Beverwykella Campylospora Ceratosporella Clavariopsis Clavatospora Crucella
    Culicidospora Cylindrocarpon Dendrospora Dimorphospora Fontanospora Geniculospora Lateriramulosa Lemonniera
    Mycocentrospora Pseudoanguillospora Stenocladiella Tetrachaetum Tetracladium Tetranacrium Tricellula Tricladium
    Triscelophorus Tumularia Varicosporium Volucrispora Wiesneriomyces Ypsilina Anguillospora Centrospora Cylindrocladium
    Dactylella Diplocladiella Flagellospora Goniopila Gyoerffyella Isthmolongispora Lunulospora Margaritispora Mycofalcella
    Rhexoacrodictys Setosynnema Sigmoidea Spirosphaera Tricladiopsis Actinocladium Articulospathulata Condylospora
    Curucispora Hidroceras Mycoenterolobium Phalangispora Speiropsis Synnematomyces Tripospermum Triposporium
    Trisulcosporium Vargamyces Camposporium Dactylaria Helicomyces Heliscus Pleurophragmium Subulispora Taeniolella
    Trichothecium Xylomyces Helicodendron Helicosporium Helicoon Helicubis Neta Aquaphila Nawawia Pyricularia""".split()
)
#: Genera of the vocabulary for legends (fixed values).
LEGEND_GENERA = tuple(
    """Actinospora Alatospora Anguillospora Articulospora Campylospora Casaresia Centrospora Ceratopsis Clavariopsis
    Clavatospora Condylospora Culicidospora Cylindrocarpon Dactylella Dendrospora Descalsia Diplocladiella Dwayaangam
    Filosporella Flabellocladia Flagellospora Fontanospora Geniculospora Goniopila Gyoerffyella Heliscella Heliscina Heliscus
    Helicoon Helicomyces Helicodendron Helicosporium Helicomina Helicoma Hydrometrospora Ingoldiella Isthmolongispora
    Isthmotricladia Jaculispora Lateriramulosa Lemonniera Leptosporomyces Lunulospora Magdalaenaea Margaritispora
    Mycocentrospora Pleuropedium Pseudaegerita Pyramidospora Retiarius Scorpiosporium Sigmoidea Speiropsis Stenocladiella
    Taeniospora Tetrachaetum Tetracladium Tricellula Tricladium Trinacrium Tripospermum Triposporina Triscelophorus Tumularia
    Varicosporium Volucrispora Xylomyces Brachiosphaera Camposporidium Camposporium Cancellidium Dicranidion Hydrocina
    Mirandina Pestalotia Piricauda Riessia Spegazzinia Trichocladium Wiesneriomyces""".split()
)
#: Confidence of each way to find a name (fixed values), and the factor for a genus outside the vocabulary.
CONFIDENCE = {
    "legend_strict": 0.95,
    "legend_loose": 0.85,
    "caption_pairs": 0.80,
    "abbreviated": 0.70,
    "adjacent_pages": 0.65,
    "proximity_binomial": 0.55,
    "page_fallback": 0.40,
    "pdf_filename": 0.15,
}
UNKNOWN_GENUS_FACTOR = 0.55


def blocked(text: Column) -> Column:
    return text.rlike(BLOCKED_SECTION)


def noisy(text: Column) -> Column:
    """Whether a caption is a notice of rights or a letterhead."""
    low = F.lower(text)
    hit = F.lit(False)
    for k in NOISE_KEYWORDS:
        hit = hit | low.contains(k)
    return F.coalesce(hit, F.lit(False))


def known_genus(genus: Column, vocabulary: Iterable[str] | None) -> Column:
    """Membership in a controlled vocabulary (a bounded list); always true without one."""
    return F.lit(True) if vocabulary is None else genus.isin(*sorted({v.strip() for v in vocabulary if isinstance(v, str) and v.strip()}))


def genus_syntax(genus: Column, not_genera: Iterable[str] = NOT_GENERA) -> Column:
    """At least four letters, the first upper case, the rest lower or hyphens, no suffix of other ranks or words."""
    return (
        (F.length(genus) >= 4) & genus.rlike(r"^\p{Lu}[\p{Ll}\-]*$") & ~genus.rlike(f"({'|'.join(NOT_A_GENUS_SUFFIX)})$") & ~genus.isin(*not_genera)
    )


def epithet_syntax(epithet: Column, not_epithets: Iterable[str] = NOT_LEGEND_EPITHETS) -> Column:
    return epithet.rlike(r"^[\p{Ll}\-]{3,}$") & ~epithet.isin(*not_epithets)


def valid_binomial(genus: Column, epithet: Column, vocabulary: Iterable[str] | None = None) -> Column:
    """Whether both words can be a name in a legend, of a genus in the vocabulary if there is one."""
    return genus_syntax(genus, NOT_LEGEND_GENERA) & epithet_syntax(epithet) & known_genus(genus, vocabulary)


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def first_binomial(text: Column) -> Column:
    """The first ``Genus_species`` of a caption whose epithet no hyphen follows; null if there is none."""
    g, s = F.regexp_extract(text, DRAWING_BINOMIAL, 1), F.regexp_extract(text, DRAWING_BINOMIAL, 2)
    return F.when(g != "", F.concat_ws("_", g, s))
