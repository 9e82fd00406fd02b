"""Fixed values that must equal the reference's for identical results.

They are the reference's own vocabulary (Portuguese survey column and class names,
label encodings, output wording and colours), given here plainly and in their natural
order.  Every operator takes them as parameters; these are only the defaults.
"""

# --- fixed values: non-score columns of the assessment sheet (everything else is a score)
ID_COLUMNS = ["Ponto", "PontoID", "Data", "Campo", "Equipe", "Especie01", "Avaliador"]

# --- fixed values: the scores excluded from the binary model as near-copies of the label
LEAKY_SCORE_PATTERNS = ["Degrad", "Manejo"]

# --- fixed values: the five degradation classes, from none to most severe (ordinal 0..4)
CLASS_ORDER = [
    "Não degradada",
    "Degradação Baixa",
    "Degradação Moderada",
    "Degradação Agrícola Severa",
    "Degradação Biológica Severa",
]

# --- fixed values: the classes forming the binary negative class (label 0)
NEGATIVE_CLASSES = ["Não degradada", "Degradação Baixa"]

# --- fixed values: prediction text and map colour for the binary model
PREDICTION_TEXT = {1: "DEGRADADA", 0: "NÃO DEGRADADA"}
PREDICTION_RGB = {1: [255, 0, 0], 0: [0, 255, 0]}

# --- fixed values: explanation wording (format specs as in the reference: .2f and .2%)
TEXT_BASE = ("O valor base (médio) de log-odds é de {base}, o que corresponde a uma "
             "probabilidade inicial de degradação igual a {prob}.")
TEXT_STEP = ("A variável '{feature}' {direction} o log-odds em {amount} unidades, o que fez "
             "a probabilidade se tornar {prob}.")
TEXT_FINAL = "Assim, a probabilidade final de que a pastagem está DEGRADADA é {prob}."
TEXT_UP = "aumentou"
TEXT_DOWN = "diminuiu"

# --- fixed values: split, search and tree seeds and sizes
TEST_SHARE = 0.3
SPLIT_SEED = 667
SEARCH_SEED = 668
TREE_SEED = 700
TREE_DEPTH = 4
N_FOLDS = 5
BOX_WHISKER = 1.5

# --- fixed values: the booster's trees, the search's candidates and its space
BOOSTED_TREES = 500
SEARCH_CANDIDATES = 30
SEARCH_SPACE = {
    "max_depth": ("int", 2, 100),
    "colsample_bytree": ("uniform", 0.1, 1.0),
    "scale_pos_weight": ("uniform", 1.0, 50.0),
    "learning_rate": ("log-uniform", 1e-4, 1.5),
    "reg_alpha": ("log-uniform", 1e-5, 10.0),
    "reg_lambda": ("log-uniform", 1e-5, 10.0),
}

# --- fixed values: the one-point parameter grid of the five-class booster
MULTICLASS_GRID = {"nrounds": [100], "max_depth": [10], "eta": [0.3], "gamma": [0],
                   "colsample_bytree": [0.9], "min_child_weight": [0], "subsample": [0.9]}

# --- fixed values: the features of the five-class booster
MULTICLASS_FEATURES = ["EstDesenv_media", "Invasoras_media", "Cupins_media", "CobertSolo_media", "DispForr_media",
                       "DispFolhVerd_media", "CondAtual_media", "PotProd_media", "Altura", "Degrad_media",
                       "Manejo_media"]
