"""Codes of the data model. They are what the files hold."""

from __future__ import annotations

#: How a particle came about.
INTERACTION = dict(track=1, neutron=2, nucleus=3, photon=4, primary=5, compton=6, delta=7, conversion=8, ionization=9, photoelectron=10, decay=11, other_shower=12, invalid=13)
#: What its points look like.
SEMANTIC = dict(shower=1, track=2, delta=3, michel=4, le_scatter=5, unknown=6)
#: Which label wins a contested voxel: lowest rank first; anything else is last.
SEMANTIC_RANK = {2: 0, 1: 1, 3: 2, 4: 3, 5: 4, 6: 5}
OTHER_RANK = 6
#: Simulation process codes, and the subprocess codes of the electromagnetic and the hadronic one.
PROCESS = dict(electromagnetic=2, decay=6, hadronic=4)
SUBPROCESS = dict(ionization=2, pair_production=4, photoelectric=12, compton=13, conversion=14, hadron_151=151)
