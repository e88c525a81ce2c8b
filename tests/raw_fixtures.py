"""Tiny raw JSON trees for ingestion tests (field names as the source reads them)."""

import json
import os


def _event(i, team, player, typ, minute, second, **extra):
    e = {"id": f"ev-{i}", "index": i, "period": 1, "timestamp": f"00:{minute:02d}:{second:02d}.000",
         "minute": minute, "second": second, "type": {"id": typ[0], "name": typ[1]},
         "team": {"id": team, "name": f"Team {team}"},
         "player": {"id": player, "name": f"Player {player}"}, "location": [10.0 + i, 20.0]}
    e.update(extra)
    return e


def write_tree(root, *, bom=False, corrupt=True, empty=True, bad_name=False):
    os.makedirs(f"{root}/events", exist_ok=True)
    os.makedirs(f"{root}/matches/2", exist_ok=True)
    os.makedirs(f"{root}/lineups", exist_ok=True)
    os.makedirs(f"{root}/three-sixty", exist_ok=True)
    ev1 = [_event(1, 10, 100, (30, "Pass"), 0, 1, **{"pass": {"end_location": [50.0, 30.0],
                                                             "recipient": {"id": 101, "name": "Player 101"}}}),
           _event(2, 10, 101, (16, "Shot"), 0, 5, shot={"statsbomb_xg": 0.2, "end_location": [120.0, 40.0, 1.0],
                                                         "outcome": {"id": 97, "name": "Goal"},
                                                         "type": {"id": 87, "name": "Open Play"},
                                                         "body_part": {"id": 40, "name": "Right Foot"}}),
           _event(3, 20, 200, (17, "Pressure"), 1, 0),
           {"id": "ev-1", "index": 1, "period": 1, "minute": 0, "second": 1, "type": {"id": 30, "name": "Pass"},
            "team": {"id": 10, "name": "Team 10"}, "player": {"id": 100, "name": "Player 100"}}]
    text = json.dumps(ev1)
    with open(f"{root}/events/1001.json", "w", encoding="utf-8") as f:
        f.write(("﻿" if bom else "") + text)
    with open(f"{root}/events/1002.json", "w") as f:  # a single object file
        json.dump(_event(7, 20, 201, (30, "Pass"), 2, 0), f)
    if corrupt:
        with open(f"{root}/events/1003.json", "w") as f:
            f.write('[{"id": "x", "minute": 1,')
    if empty:
        open(f"{root}/events/1004.json", "w").close()
    if bad_name:
        with open(f"{root}/events/abc.json", "w") as f:
            json.dump([_event(9, 10, 100, (30, "Pass"), 0, 0)], f)
    matches = [{"match_id": 1001, "match_date": "2024-01-01", "kick_off": "15:00",
                "competition": {"competition_id": 2, "competition_name": "League"},
                "season": {"season_id": 5, "season_name": "2024"},
                "home_team": {"home_team_id": 10, "home_team_name": "Home FC"},
                "away_team": {"away_team_id": 20, "away_team_name": "Away FC"},
                "home_score": 1, "away_score": 0, "match_status": "available"},
               {"match_id": 1002, "match_date": "2024-01-08",
                "competition": {"competition_id": 2}, "season": {"season_id": 5},
                "home_team": {"home_team_id": 20, "home_team_name": "Away FC"},
                "away_team": {"away_team_id": 30, "away_team_name": ""}}]
    with open(f"{root}/matches/2/5.json", "w") as f:
        json.dump(matches, f)
    with open(f"{root}/competitions.json", "w") as f:
        json.dump([{"competition_id": 2, "competition_name": "League", "country_name": "X",
                    "competition_gender": "male", "competition_youth": False, "season_id": 5,
                    "season_name": "2024"}], f)
    lineups = [{"team_id": 10, "team_name": "Home FC", "lineup": [
        {"player_id": 100, "player_name": "Player 100", "jersey_number": 1,
         "positions": [{"position_id": 1, "position": "Goalkeeper", "from": "00:00", "to": None,
                        "start_reason": "Starting XI"}]},
        {"player_id": 101, "player_name": "Player 101", "jersey_number": 9,
         "positions": [{"position_id": 23, "position": "Center Forward", "from": "60:00", "to": None,
                        "start_reason": "Substitution - On"}]}]},
        {"team_id": 20, "team_name": "Away FC", "lineup": []}]
    with open(f"{root}/lineups/1001.json", "w") as f:
        json.dump(lineups, f)
    ts = [{"event_uuid": "ev-2", "visible_area": [0, 0, 10, 0, 10, 10, 0, 10, 0, 0],
           "freeze_frame": [{"teammate": True, "actor": True, "keeper": False, "location": [100.0, 40.0]},
                            {"teammate": False, "actor": False, "keeper": True, "location": [118.0, 40.0]}]}]
    with open(f"{root}/three-sixty/1001.json", "w") as f:
        json.dump(ts, f)
