"""Sample label strings of our own, from which the views draw."""

#: Sample labels: plain, compound, misread and unwanted strings, so that each rule has hits and misses.
LEXICON = (
    "water", "Sugar", "salt", "Wheat Flour", "palm oil", "skimmed milk powder", "Emulsifier (E322, E476)", "cocoa butter", "almond flour",
    "coconut", "Egg Yolk", "eggplant", "Pork Gelatin", "white wine vinegar", "citric acid", "E 330", "e-471", "Raising Agent: E450, E501",
    "natural flavoring", "soy lecithin", "Sun Flower oil (12%)", "butter milk", "unsalted butter milk solids", "raisin agent", "[vanilla]",
    "*organic oats", "INGREDIENTS:", "Ingredients: rice, corn", "ingrodlonts: tea", "List of ingredients", "best before end 12/2025",
    "Store in a cool dry place", "May contain traces of nuts", "Contains: milk, egg", "contains sulphites", "Added sugar", "www.example.com",
    "100g", "42", "30%", "x", "--", "and spices", "of which sugars 3g", "Manufactured by Example Ltd", "honey", "fish sauce", "Chicken stock",
    "mustard seeds", "sesame oil", "chocolate (sugar, cocoa mass, (milk) solids)", "Acid: lactic acid", "tomato puree 40%", "rice & beans",
    "sea salt; pepper", "carrots and peas", "vitamin c contributes to normal function of the immune system and is part of a healthy lifestyle for all",
    "peanuts,", "oat flour.", "sultana", "salt caramelised nuts", "A/B-1", "(may vary)", "suger", "watr", "E330", "  cheese  ", "olein acid", "natural",
    "For allergens see bold",
)
