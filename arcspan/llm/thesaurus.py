"""Further names of the entries of the type list, handed to the mapping as a table.

Labels, their translations, plurals, misspellings, shortened words and words without vowels need no line here: the mapping
finds them itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = {
    "settlement": ["living site", "village site", "Siedlung", "habitat", "habitation", "habitation site", "occupation site", "asentamiento", "insediamento", "open settlement"],
    "cave": ["grotta", "grotto", "cavern", "cueva", "cave site", "karst cave", "cave karst"],
    "rock shelter": ["abri sous roche", "overhang", "shelter under rock", "abrigo rocoso"],
    "cemetery": ["necropolis", "necropoli", "burial ground", "graveyard", "cementerio", "grave field", "cemetery area"],
    "burial mound": ["tumulo", "barrow", "kurgan", "round barrow", "earthen burial mound"],
    "megalithic tomb": ["megalith tomb", "dolmen", "passage grave", "gallery grave", "allée couverte", "Hünengrab", "sepulcro megalítico"],
    "stone circle": ["stone ring", "ring of stones", "circle of stones", "circle stone", "círculo de piedras"],
    "hillfort": ["castro", "Ringwall", "éperon barré", "fortified hilltop", "defended hilltop"],
    "enclosure": ["Grabenwerk", "recinto", "recinto de fosos", "enclosed area", "ditched enclosure", "causewayed enclosure"],
    "sanctuary": ["santuario", "sacred site", "holy place", "cult place", "Kultplatz", "Heiligtum", "lieu de culte"],
    "temple": ["templo", "tempio", "temple precinct", "temple building"],
    "monastery": ["monasterio", "abbey", "Abtei", "priory", "convent"],
    "quarry": ["cantera", "stone pit", "Steinbruchareal", "stone extraction site", "quarry site"],
    "mine": ["mina", "mining site", "Feuersteinbergwerk", "flint mine", "copper mine", "mine shaft"],
    "workshop": ["taller", "atelier", "Schlagplatz", "knapping site", "craft area", "production site"],
    "harbour": ["harbor", "puerto", "Hafenanlage", "anchorage", "landing place", "port site"],
    "farmstead": ["farm", "Einzelhof", "granja", "homestead", "single farm", "farm site"],
    "shell midden": ["kitchen midden", "shell mound", "shell heap", "Muschelhügel", "conchero", "sambaqui"],
    "settlement mound": ["tepe", "höyük", "Siedlungshügel", "occupation mound", "tell site", "tell mound"],
    "lake dwelling": ["palafito", "lakeside dwelling", "pile dwelling", "pile village", "stilt houses", "Feuchtbodensiedlung"],
    "campsite": ["campamento", "camp", "Freilandstation", "seasonal camp", "open air camp", "hunting camp"],
    "watchtower": ["w tower", "lookout tower", "signal tower", "torre de vigilancia", "tour de guet"],
    "pit": ["Grubenfüllung", "hoyo", "fosa", "rubbish pit", "pit feature", "pit fill"],
    "posthole": ["post socket", "Pfostengrube", "hoyo de poste", "buca di palo", "PH"],
    "hearth": ["fire place", "fireplace", "open fire", "Feuerstelle", "focolare", "hogar", "combustion feature"],
    "ditch": ["foso", "fossato", "Grabenfüllung", "boundary ditch", "ditch section", "ditch fill"],
    "inhumation grave": ["single burial", "skeleton grave", "flat grave", "tumba de inhumación", "sépulture"],
    "cremation grave": ["incineración", "cremation", "cremated burial", "urn burial", "urn grave", "Urnengrab", "Brandgrab"],
    "floor": ["sol", "sol d'habitat", "suelo de ocupación", "clay floor", "house floor", "floor level"],
    "wall": ["muro", "Mauerwerk", "stone wall", "drystone wall", "mudbrick wall", "wall footing"],
    "well": ["pozo", "pozzo", "Brunnenschacht", "water well", "timberlined well", "well shaft"],
    "kiln": ["Töpferofen", "horno de alfarero", "lime kiln", "pottery kiln", "potters kiln"],
    "oven": ["horno de pan", "tannur", "Lehmofen", "bread oven", "baking oven", "cooking oven"],
    "storage pit": ["grain pit", "granary pit", "Getreidegrube", "fosa de almacenamiento", "silo pit"],
    "cistern": ["cisterna", "aljibe", "water tank", "rainwater tank", "cistern basin"],
    "foundation trench": ["bedding trench", "footing trench", "wall trench", "Wandgräbchen", "zanja de cimentación", "tranchée de fondation"],
    "pavement": ["paving", "paved area", "paved surface", "cobbling", "cobbled surface", "Pflaster", "Steinpflaster", "empedrado"],
    "burial chamber": ["grave chamber", "tomb chamber", "chamber of the tomb", "cámara funeraria"],
    "rampart": ["defensive bank", "bank and palisade", "Wallanlage", "muralla", "earth rampart"],
    "drain": ["drainage channel", "sewer", "Kanal", "desagüe", "drain channel"],
    "smelting furnace": ["furnace", "smelter", "bloomery", "Rennofen", "horno de fundición", "iron furnace"],
    "destruction layer": ["destruction level", "burnt layer", "conflagration layer", "Brandschicht", "couche d'incendie", "nivel de destrucción"],
    "cultural layer": ["occupation layer", "occupation deposit", "anthropic layer", "find layer", "Fundschicht", "couche archéologique", "nivel arqueológico"],
}


def names_table(spark: SparkSession) -> DataFrame:
    """label and name, one row a name."""
    return spark.createDataFrame([(label, name) for label, names in NAMES.items() for name in names], "label string, name string")
