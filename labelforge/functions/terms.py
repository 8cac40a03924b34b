"""The terms of diets and allergens, in the order in which warnings name them.

Verdicts and prompts depend on each term and on their order, so the lists are stated whole.
"""

# --- fixed values: terms of the rules ------------------------------------------------------------------
TERMS = {
    "gluten": (
        "gluten", "wheat", "wheat flour", "whole wheat", "whole wheat flour", "wheat flour (atta)", "atta", "maida", "semolina", "durum",
        "durum wheat", "durum wheat semolina", "spelt", "kamut", "farro", "einkorn", "emmer", "bulgur", "couscous", "bran", "wheat bran",
        "wheat germ", "malt", "barley", "barley flour", "barley malt", "barley malt extract", "malted barley", "malt extract", "malt vinegar",
        "rye", "rye flour", "oats", "oat flakes", "oat bran", "triticale", "seitan", "breadcrumbs", "bread crumbs", "wheat starch",
        "modified wheat starch",
    ),
    "dairy": (
        "milk", "whole milk", "skimmed milk", "skimmilk", "skim milk", "semi-skimmed milk", "condensed milk", "evaporated milk", "milk solids",
        "milk powder", "milk protein", "milk proteins", "milk fat", "milk permeate", "milk derivative", "dried milk", "dried whole milk",
        "dried skimmed milk", "skimmed milk powder", "whole milk powder", "cheese", "cheddar", "mozzarella", "parmesan", "gouda", "gruyere",
        "butter", "butterfat", "butter oil", "cream", "double cream", "single cream", "sour cream", "whipping cream", "yogurt", "yoghurt",
        "greek yogurt", "greek yoghurt", "greek style yogurt", "greek style yoghurt", "kefir", "curd", "custard", "whey", "whey powder",
        "whey protein", "whey protein concentrate", "whey solids", "casein", "caseinate", "sodium caseinate", "calcium caseinate", "lactose",
        "buttermilk", "ghee", "from milk", "(milk)",
    ),
    "nuts": (
        "nut", "nuts", "peanut", "peanuts", "groundnut", "groundnuts", "almond", "almonds", "walnut", "walnuts", "cashew", "cashews",
        "cashewnut", "cashewnuts", "hazelnut", "hazelnuts", "pecan", "pecans", "pistachio", "pistachios", "pistachio nuts", "macadamia",
        "macadamias", "macadamia nuts", "brazil nut", "brazil nuts", "pine nut", "pine nuts", "chestnut", "chestnuts", "mixed nuts",
        "nut pieces", "nut flour", "nut paste", "almond flour", "almond meal", "almond paste", "hazelnut paste", "cashew paste", "peanut butter",
    ),
    "eggs": (
        "egg", "eggs", "egg white", "egg whites", "egg yolk", "egg yolks", "albumin", "ovalbumin", "egg albumen", "dried egg", "powdered egg",
        "pasteurised egg", "pasteurized egg", "egg powder", "meringue",
    ),
    "soy": (
        "soy", "soya", "soybean", "soybeans", "soy bean", "soy flour", "soya flour", "soy protein", "soy protein isolate", "soya protein",
        "soya protein isolate", "isolated soya protein", "soy lecithin", "soya lecithin", "lecithin (soya)", "textured soy protein",
        "textured vegetable protein", "tvp", "soy milk", "soya milk", "soy sauce", "soya sauce", "tofu", "tempeh", "miso", "edamame",
    ),
    "halal": (
        "pork", "pork fat", "pork gelatin", "pork gelatine", "ham", "bacon", "lard", "pepperoni", "salami", "prosciutto", "pancetta", "chorizo",
        "mortadella", "gelatin", "gelatine", "blood", "blood plasma", "rum", "wine", "beer", "brandy", "whisky", "whiskey", "vodka", "liqueur",
        "alcohol", "ethanol", "mirin", "cooking wine",
    ),
    "vegetarian": (
        "meat", "chicken", "beef", "pork", "bacon", "ham", "turkey", "duck", "lamb", "mutton", "veal", "fish", "salmon", "tuna", "anchovy",
        "anchovies", "sardine", "sardines", "cod", "prawn", "shrimp", "crab", "lobster", "gelatin", "gelatine", "animal fat", "beef fat",
        "chicken fat", "fish oil", "meat extract", "chicken extract", "beef extract", "stock", "chicken stock", "beef stock", "fish stock",
        "broth", "chicken broth", "beef broth", "animal rennet", "rennet", "lard", "suet", "shellfish", "oyster", "mussel", "clam",
    ),
    "vegan": (
        "milk", "whole milk", "skimmed milk", "skim milk", "milk solids", "milk powder", "milk protein", "milk fat", "cheese", "butter",
        "butterfat", "butter oil", "cream", "yogurt", "yoghurt", "kefir", "curd", "custard", "whey", "whey powder", "whey protein", "casein",
        "caseinate", "lactose", "buttermilk", "ghee", "egg", "eggs", "egg white", "egg yolk", "albumin", "ovalbumin", "honey", "beeswax",
        "royal jelly", "propolis", "meat", "chicken", "beef", "pork", "fish", "shellfish", "gelatin", "gelatine", "lard", "suet", "animal fat",
        "meat extract", "chicken stock", "beef stock", "fish oil", "anchovy", "anchovies", "rennet", "animal rennet",
    ),
}

# --- fixed values: terms that a prompt names as not allowed --------------------------------------------
BANNED = {
    "vegan": (
        "meat", "chicken", "beef", "pork", "lamb", "turkey", "duck", "venison", "fish", "salmon", "tuna", "cod", "anchovy", "anchovies",
        "sardine", "herring", "shrimp", "prawn", "crab", "lobster", "shellfish", "squid", "egg", "eggs", "albumin", "ovalbumin", "milk", "cream",
        "butter", "cheese", "yoghurt", "yogurt", "whey", "casein", "lactose", "ghee", "buttermilk", "honey", "beeswax", "royal jelly",
        "gelatin", "gelatine", "lard", "suet", "animal fat", "tallow", "chicken stock", "beef stock", "fish stock", "bone broth", "rennet",
        "carmine", "cochineal", "isinglass",
    ),
    "vegetarian": (
        "meat", "chicken", "beef", "pork", "lamb", "turkey", "duck", "venison", "fish", "salmon", "tuna", "cod", "anchovy", "anchovies",
        "sardine", "herring", "shrimp", "prawn", "crab", "lobster", "shellfish", "squid", "gelatin", "gelatine", "lard", "suet", "animal fat",
        "tallow", "chicken stock", "beef stock", "fish stock", "bone broth", "chicken extract", "beef extract", "meat extract", "rennet",
    ),
    "halal": (
        "pork", "pig", "ham", "bacon", "lard", "pepperoni", "salami", "chorizo", "prosciutto", "pancetta", "mortadella", "gelatin", "gelatine",
        "blood", "alcohol", "wine", "beer", "rum", "vodka", "whisky", "whiskey", "brandy", "liqueur", "ethanol", "mirin", "cooking wine",
    ),
    "gluten-free": (
        "wheat", "wheat flour", "barley", "rye", "oats", "oat flakes", "spelt", "semolina", "durum", "bulgur", "couscous", "malt",
        "malt extract", "gluten", "seitan", "breadcrumbs",
    ),
    "dairy-free": (
        "milk", "whole milk", "skimmed milk", "cream", "butter", "cheese", "yoghurt", "yogurt", "whey", "casein", "caseinate", "lactose", "ghee",
        "buttermilk", "custard", "kefir",
    ),
    "nut-free": (
        "almond", "almonds", "walnut", "walnuts", "cashew", "cashews", "hazelnut", "hazelnuts", "pecan", "pecans", "pistachio", "pistachios",
        "peanut", "peanuts", "groundnut", "groundnuts", "macadamia", "brazil nut", "pine nut", "chestnut", "nut", "nuts",
    ),
}
