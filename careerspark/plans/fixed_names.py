"""Name aliases and corrections of the ranking lists.

Fixed values: misspelt or informal names, IDs that no name match finds, and rows known to be wrong. They must be
exactly these for the published ranking table; pass other tables for other data.
"""

from __future__ import annotations

from ..operators.resolve import Correction

# Misspellings corrected before any look-up.
GENERAL_ALIASES = {
    "Carlos Gonzales": "Carlos Gonzalez",
    "Miguel Tejeda": "Miguel Tejada",
}

# Names whose spelling differs from the people table, corrected before the last look-up.
ALIASES = {
    "Adam Laroche": "Adam LaRoche",
    "Albert Almora": "Albert Almora Jr.",
    "Alexis Rios": "Alex Rios",
    "Andy Laroche": "Andy LaRoche",
    "Andy Oliver": "Andrew Oliver",
    "Andy Sisco": "Andrew Sisco",
    "Angelo Jimenez": "D'Angelo Jimenez",
    "Blake Dewitt": "Blake DeWitt",
    "CJ Abrams": "C.J. Abrams",
    "CJ Nitkowski": "C.J. Nitkowski",
    "Dan Hudson": "Daniel Hudson",
    "Daniel Cortes": "Dan Cortes",
    "Den Peltier": "Dan Peltier",
    "Dennis Reyes": "Dennys Reyes",
    "Dermal Brown": "Dee Brown",
    "Donald Veal": "Donnie Veal",
    "Edison Volquez": "Edinson Volquez",
    "Eric Dubose": "Eric DuBose",
    "Frank Rodriguez": "Frankie Rodriguez",
    "Garrett Anderson": "Garret Anderson",
    "Jacob Peavy": "Jake Peavy",
    "Jennry Mejia": "Jenrry Mejia",
    "John Vanbenschoten": "John Van Benschoten",
    "Johnvan Benschoten": "John Van Benschoten",
    "Jon Vanbenschoten": "John Van Benschoten",
    "Jon Hurst": "Jonathan Hurst",
    "Jon Papelbon": "Jonathan Papelbon",
    "Jonathan Singleton": "Jon Singleton",
    "Joshua James": "Josh James",
    "Kendry Morales": "Kendrys Morales",
    "Latroy Hawkins": "LaTroy Hawkins",
    "Mackenzie Gore": "MacKenzie Gore",
    "Makato Suzuki": "Mac Suzuki",
    "Manuel Aybar": "Manny Aybar",
    "Matt Laporta": "Matt LaPorta",
    "Matt Lecroy": "Matt LeCroy",
    "Maurice Vaughn": "Mo Vaughn",
    "Mike Macdougal": "Mike MacDougal",
    "Philip Hughes": "Phil Hughes",
    "Ron Belliard": "Ronnie Belliard",
    "Russ Branyan": "Russell Branyan",
    "Shawn Gree": "Shawn Green",
    "Stephen Cooke": "Steve Cooke",
    "Sun Woo Kim": "Sun-Woo Kim",
    "Tom Howard": "Thomas Howard",
    "Travis D'Arnaud": "Travis d'Arnaud",
    "Wilfredo Cordero": "Wil Cordero",
    "Zach Britton": "Zack Britton",
}

# IDs of names that no source spells this way.
ID_BY_NAME = {
    "Albert Almora Jr.": "almoa002",
    "Andrew Oliver": "oliva002",
    "Andrew Sisco": "sisca001",
    "C.J. Abrams": "abrac001",
    "Geraldo Perdomo": "perdg001",
    "Jesus E. Sanchez": "sancj003",
    "Sandy Alomar Jr.": "aloms001",
}

# Rows removed because another person of the same name was meant.
WRONG_IDS = ("garcl002", "garcl003", "andeb006")

# Corrections of single rows; the first rule that fits is used.
CORRECTIONS = (
    *(Correction({"ID": wrong}, drop_row=True) for wrong in WRONG_IDS),
    Correction({"ID": "andeb003", "POSITION_1": 1.0}, {"ID": "andeb002"}),
    Correction({"ID": "garcl006", "TEAM": "Phillies"}, {"ID": None}),
    Correction({"ID": "greec003"}, {"ID": None}),
    Correction({"ID": "bradb002", "TEAM": "Pirates"}, {"ID": None}),
    Correction({"ID": "sanca003"}, {"ID": "sanca002"}),
    Correction({"ID": "lopej002"}, {"ID": "lopej001", "PLAYER_NAME": "Javy Lopez"}),
    Correction({"ID": "valej003"}, {"ID": "valej004", "PLAYER_NAME": "Javier Valentin"}),
    Correction({"ID": "santj003"}, {"ID": "sante001", "PLAYER_NAME": "Ervin Santana"}),
    Correction({"ID": "hernc003"}, {"ID": "hernc004"}),
    Correction({"ID": "whitm003"}, {"ID": None}),
    Correction({"PLAYER_NAME": "Angel Martinez"}, {"ID": "marta002", "PLAYER_NAME": "Sandy Martinez"}),
    Correction({"PLAYER_NAME": "Calvin Reese"}, {"ID": "reesp001", "PLAYER_NAME": "Pokey Reese"}),
    Correction({"PLAYER_NAME": "Edgard Velasquez"}, {"ID": "cleme001", "PLAYER_NAME": "Edgard Clemente"}),
    Correction({"PLAYER_NAME": "Jacob McGee"}, {"ID": "mcgej001", "PLAYER_NAME": "Jake McGee"}),
    Correction({"PLAYER_NAME": "Matthew Lecroy"}, {"ID": "lecrm001", "PLAYER_NAME": "Matt LeCroy"}),
    Correction({"PLAYER_NAME": "Michael Inoa"}, {"ID": "ynoam001", "PLAYER_NAME": "Michael Ynoa"}),
    Correction({"PLAYER_NAME": "Robert Smith"}, {"ID": "smitr003", "PLAYER_NAME": "Bob Smith"}),
    Correction({"PLAYER_NAME": "Jesus E. Sanchez"}, {"ID": "sancj003", "PLAYER_NAME": "Jesus Sanchez"}),
)

# Name shared by two players in the later release of the people table.
AMBIGUOUS_IN_UPDATE = ("Luis Garcia",)
