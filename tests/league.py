"""The small invented league most tests share: two clubs, three teams, a player on two rosters, and dirty rows around them."""

from __future__ import annotations

SCOPE = ("Cadetes", "Zona Norte", "F")


def raw_tables(frame, dirty: bool = True) -> dict:
    teams = [("41", "6", 8, *SCOPE, "A"), ("42", "7", 8, *SCOPE, "A"), ("43", "6", 8, *SCOPE, "C")]
    rosters = [
        (1, "71", "43", 15, "Pivot"), (2, "72", "42", 4, "Central"), (3, "73", "43", 22, "Arquera"), (4, "71", "41", 5, "Pivot"),
    ]
    matches = [
        (501, "2025-04-12", "16:30:00", 3, "41", "42", "finalizado", 27, 24),
        (502, "2025-05-03", "11:00:00", 5, "42", "41", "programado", None, None),
        (503, "2025-04-19", "18:45:00", 4, "42", "43", "finalizado", 21, 25),
    ]
    lines = [
        (1, "501", "71", "41", 9, 2, 0), (2, "501", "72", "42", 7, 0, 1), (3, "503", "71", "43", 3, 0, 0),
        (4, "503", "73", "43", 2, 0, 0),
    ]
    if dirty:
        # unknown club, another season, no club, an id that is no number
        teams += [("44", "60", 8, *SCOPE, "A"), ("45", "6", 9, *SCOPE, "A"), ("46", None, 8, *SCOPE, "A"), ("s/n", "6", 8, *SCOPE, "A")]
        # unknown player, unknown team, dropped team, no player, an id that is no number
        rosters += [
            (80, "700", "41", 50, None), (81, "71", "400", 51, None), (82, "72", "44", 52, None), (83, None, "42", 53, None),
            (84, "73", "s/n", 54, None),
        ]
        # away, home or both teams unknown, a dropped team
        matches += [
            (510, "2025-06-01", None, None, "41", "400", "finalizado", 12, 13), (511, "2025-06-02", None, None, "400", "42", "finalizado", 15, 9),
            (512, "2025-06-03", None, None, "401", "402", "finalizado", 8, 8), (513, "2025-06-04", None, None, "44", "41", "finalizado", 19, 16),
        ]
        # a team, match or player missing; an unknown team or match; a team that did not play; lines of dropped matches
        lines += [
            (20, "501", "71", None, 40, 0, 0), (21, None, "71", "41", 40, 0, 0), (22, "501", None, "41", 40, 0, 0),
            (23, "501", "71", "400", 40, 0, 0), (24, "599", "71", "41", 40, 0, 0), (25, "501", "71", "43", 40, 0, 0),
            (26, "510", "71", "41", 40, 0, 0), (27, "513", "71", "41", 40, 0, 0),
        ]
    return {
        "clubes": frame(
            "id int, nombre string, abreviatura string, ciudad string, logo_url string, activo boolean",
            (6, "Molino Azul", "MOA", "Puerto Inventado", "https://liga.example/molino.png", True),
            (7, "C.D. Los Cerezos", None, None, None, True),
        ),
        "equipos": frame(
            "id string, club_id string, temporada_id int, categoria string, division string, rama string, equipo_codigo string",
            *teams,
        ),
        "jugadores": frame(
            "id int, nombre string, apellido string, altura_cm int", (71, "Noa", "Quillfeder", 176), (72, "Uma", "Zunderal", 169),
            (73, "Kim", "Ó", None),
        ),
        "planteles": frame("id int, jugador_id string, equipo_id string, dorsal int, posicion string", *rosters),
        "partidos": frame(
            "id int, fecha string, hora string, jornada int, local_equipo_id string, visitante_id string, estado string, "
            "goles_local int, goles_visitante int",
            *matches,
        ),
        "participaciones": frame(
            "id int, partido_id string, jugador_id string, equipo_id string, goles int, dos_minutos int, amarillas int", *lines
        ),
    }
