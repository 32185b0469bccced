"""Chemical structures: functions that need a toolkit (RDKit, if installed) and native ones on sets and counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from rdkit import Chem
except ImportError:  # the functions below then say so
    Chem = None


def available() -> bool:
    return Chem is not None


def _need() -> None:
    if Chem is None:
        raise RuntimeError("this function needs RDKit, which is not installed")


def standardise(smiles: Column) -> Column:
    """Struct smiles, key, heavy_atoms, mol_weight, status: largest fragment, uncharged, canonical."""
    _need()

    @F.pandas_udf("smiles string, key string, heavy_atoms int, mol_weight double, status string")
    def run(texts: pd.Series) -> pd.DataFrame:
        from rdkit.Chem import Descriptors
        from rdkit.Chem.MolStandardize import rdMolStandardize

        rows = []
        for t in texts:
            mol = Chem.MolFromSmiles(t, sanitize=False) if t and t.strip() else None
            if mol is None:
                rows.append((None, None, None, None, "PARSE_FAIL" if t and t.strip() else "NO_SMILES"))
                continue
            try:
                Chem.SanitizeMol(mol)
                mol = rdMolStandardize.Uncharger().uncharge(rdMolStandardize.LargestFragmentChooser().choose(mol))
                rows.append((Chem.MolToSmiles(mol), Chem.MolToInchiKey(mol), mol.GetNumHeavyAtoms(), Descriptors.MolWt(mol), "OK"))
            except Exception:  # the toolkit has many error types for bad structures
                rows.append((None, None, None, None, "SANITIZE_FAIL"))
        return pd.DataFrame(rows, columns=["smiles", "key", "heavy_atoms", "mol_weight", "status"])

    return run(smiles)


def fingerprint(smiles: Column, radius: int = 2, bits: int = 2048) -> Column:
    """Set bits of the Morgan fingerprint, for the similarity joins."""
    _need()

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        from rdkit.Chem import rdFingerprintGenerator

        make = rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=bits)
        mols = texts.map(lambda t: Chem.MolFromSmiles(t) if t else None)
        return mols.map(lambda m: list(make.GetFingerprint(m).GetOnBits()) if m is not None else None)

    return run(smiles)


def scaffold(smiles: Column, generic: bool = False) -> Column:
    """Murcko scaffold, or NO_SCAFFOLD."""
    _need()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        from rdkit.Chem.Scaffolds import MurckoScaffold

        def one(t):
            mol = Chem.MolFromSmiles(t) if t else None
            core = MurckoScaffold.GetScaffoldForMol(mol) if mol is not None else None
            if core is not None and generic:
                core = MurckoScaffold.MakeScaffoldGeneric(core)
            return (Chem.MolToSmiles(core) if core is not None else "") or "NO_SCAFFOLD"

        return texts.map(one)

    return run(smiles)


def first_pattern(smiles: Column, panel: dict[str, str]) -> Column:
    """Name of the first SMARTS pattern of the panel that the structure has."""
    _need()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        patterns = [(name, Chem.MolFromSmarts(s)) for name, s in panel.items()]

        def one(t):
            mol = Chem.MolFromSmiles(t) if t else None
            return next((n for n, p in patterns if mol is not None and mol.HasSubstructMatch(p)), None)

        return texts.map(one)

    return run(smiles)


def cores(smiles: Column) -> Column:
    """Array of struct core, group: single cuts, the core being the longer fragment."""
    _need()

    @F.pandas_udf("array<struct<core:string,group:string>>")
    def run(texts: pd.Series) -> pd.Series:
        from rdkit.Chem import rdMMPA

        def one(t):
            mol = Chem.MolFromSmiles(t) if t else None
            parts = rdMMPA.FragmentMol(mol, maxCuts=1, maxCutBonds=20, resultsAsMols=False) if mol is not None else ()
            cut = [sorted(p[1].split("."), key=lambda x: (-len(x), x)) for p in parts]
            return [{"core": c[0], "group": c[1]} for c in cut if len(c) == 2]

        return texts.map(one)

    return run(smiles)


def differing_atoms(a: Column, b: Column) -> Column:
    """Struct only_a, only_b: atoms of each structure outside their largest common part."""
    _need()

    @F.pandas_udf("only_a int, only_b int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        from rdkit.Chem import rdFMCS

        rows = []
        for p, q in zip(x, y):
            one, two = Chem.MolFromSmiles(p), Chem.MolFromSmiles(q)
            n = rdFMCS.FindMCS([one, two], ringMatchesRingOnly=True, timeout=10).numAtoms
            rows.append((one.GetNumAtoms() - n, two.GetNumAtoms() - n))
        return pd.DataFrame(rows, columns=["only_a", "only_b"])

    return run(a, b)


def descriptors(smiles: Column) -> Column:
    _need()
    names = ["weight", "logp", "tpsa", "donors", "acceptors", "rotatable", "aromatic_rings", "fsp3", "charge"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        from rdkit.Chem import Crippen, Descriptors, Lipinski, rdMolDescriptors

        rows = []
        for t in texts:
            m = Chem.MolFromSmiles(t) if t else None
            rows.append([None] * len(names) if m is None else [Descriptors.MolWt(m), Crippen.MolLogP(m), rdMolDescriptors.CalcTPSA(m), Lipinski.NumHDonors(m), Lipinski.NumHAcceptors(m), Lipinski.NumRotatableBonds(m), rdMolDescriptors.CalcNumAromaticRings(m), rdMolDescriptors.CalcFractionCSP3(m), Chem.GetFormalCharge(m)])
        return pd.DataFrame(rows, columns=names, dtype="float64")

    return run(smiles)


def tanimoto(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def rule_of_five(weight: Column, logp: Column, donors: Column, acceptors: Column) -> Column:
    """Number of violations."""
    return sum(((c > most).cast("int") for c, most in ((weight, 500), (logp, 5), (donors, 5), (acceptors, 10))), F.lit(0))


def veber(tpsa: Column, rotatable: Column) -> Column:
    return (tpsa <= 140) & (rotatable <= 10)


def size_class(changed: Column, bounds: tuple[int, int, int] = (1, 3, 8)) -> Column:
    """Size of a change in atoms: single, small, medium, large."""
    return F.when(changed <= bounds[0], "single").when(changed <= bounds[1], "small").when(changed <= bounds[2], "medium").otherwise("large")


def connected(edges: Column, nodes: Column) -> Column:
    """Whether ``nodes`` (array<int>) are connected by ``edges`` (array<struct<a,b>>) among themselves."""

    def grow(reached: Column, _: Column) -> Column:
        inside = F.filter(edges, lambda e: F.array_contains(nodes, e["a"]) & F.array_contains(nodes, e["b"]))
        near = F.filter(inside, lambda e: F.array_contains(reached, e["a"]) | F.array_contains(reached, e["b"]))
        return F.array_union(reached, F.array_union(F.transform(near, lambda e: e["a"]), F.transform(near, lambda e: e["b"])))

    reached = F.aggregate(nodes, F.slice(nodes, 1, 1), grow)
    return F.size(F.array_distinct(reached)) == F.size(F.array_distinct(nodes))
