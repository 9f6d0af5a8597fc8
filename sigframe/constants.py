"""Fixed values that results depend on."""

# Clip length in seconds and embedding width per model.
MODELS = [
    ("BirdNET", 3.0, 1024),
    ("YAMNet", 0.96, 1024),
    ("Perch", 5.0, 1280),
    ("HawkEars", 3.0, 2048),
    ("BirdSetConvNeXT", 5.0, 1024),
    ("BirdSetEfficientNetB1", 5.0, 1280),
    ("RanaSierraeCNN", 2.0, 512),
]

# Windows that are stepped by one second.
COARSE_CLIP_STEPS = [2.0, 3.0]

# Integer code per taxonomic class.
CLASS_CODES = {"Aves": 0, "Amphibia": 1, "Insecta": 2, "Mammalia": 3}

# Z-score per confidence level in percent.
Z_SCORES = {50: 0.67, 68: 0.99, 90: 1.64, 95: 1.96, 99: 2.57}
