"""Fixed values of the sequence functions: residue properties, groups, motifs and link targets."""

from __future__ import annotations

# Residue -> name, mass, hydropathy, pKa, helix, sheet and turn propensity.
RESIDUES = {
    "A": ("Alanine", 89.1, 1.8, 9.69, 1.45, 0.97, 0.77),
    "R": ("Arginine", 174.2, -4.5, 10.76, 0.98, 0.90, 0.95),
    "N": ("Asparagine", 132.1, -3.5, 8.33, 0.67, 0.89, 1.56),
    "D": ("Aspartic acid", 133.1, -3.5, 3.86, 1.01, 0.39, 1.46),
    "C": ("Cysteine", 121.2, 2.5, 8.33, 0.70, 1.19, 1.77),
    "E": ("Glutamic acid", 147.1, -3.5, 4.25, 1.59, 0.52, 0.74),
    "Q": ("Glutamine", 146.2, -3.5, 8.33, 1.10, 0.84, 0.95),
    "G": ("Glycine", 75.1, -0.4, 9.60, 0.57, 0.75, 1.56),
    "H": ("Histidine", 155.2, -3.2, 6.00, 1.00, 0.87, 0.95),
    "I": ("Isoleucine", 131.2, 4.5, 9.68, 1.09, 1.67, 0.47),
    "L": ("Leucine", 131.2, 3.8, 9.60, 1.41, 1.22, 0.59),
    "K": ("Lysine", 146.2, -3.9, 9.74, 1.14, 0.52, 0.96),
    "M": ("Methionine", 149.2, 1.9, 9.21, 1.45, 1.05, 0.60),
    "F": ("Phenylalanine", 165.2, 2.8, 9.13, 1.13, 1.38, 0.60),
    "P": ("Proline", 115.1, -1.6, 10.64, 0.57, 0.55, 1.52),
    "S": ("Serine", 105.1, -0.8, 9.15, 0.77, 0.75, 1.43),
    "T": ("Threonine", 119.1, -0.7, 9.12, 0.83, 1.19, 0.96),
    "W": ("Tryptophan", 204.2, -0.9, 9.39, 1.08, 1.37, 0.65),
    "Y": ("Tyrosine", 181.2, -1.3, 9.11, 0.69, 1.47, 1.14),
    "V": ("Valine", 117.1, 4.2, 9.62, 0.91, 1.87, 0.47),
}

# The named groups of residues, which overlap.
GROUPS = {
    "hydrophobic": "AILMFPVW",
    "hydrophilic": "RNDEQHKSTY",
    "charged": "RDEHK",
    "polar": "NQSTY",
    "nonpolar": "AILMFPVW",
    "aromatic": "FWY",
    "aliphatic": "AILMV",
    "sulfur_containing": "CM",
    "basic": "RHK",
    "acidic": "DE",
    "small": "AGST",
    "large": "FILMWY",
}

# Motif -> category and pattern.
_ANY = "ACDEFGHIKLMNPQRSTVWY"
MOTIFS = {
    "n_glycosylation": ("post_translational_modification", "N[^P][ST]"),
    "o_glycosylation": ("post_translational_modification", "[ST][^P]"),
    "phosphorylation_serine": ("post_translational_modification", "[RK][RK][^RK][ST]"),
    "phosphorylation_threonine": ("post_translational_modification", "[RK][RK][^RK]T"),
    "phosphorylation_tyrosine": ("post_translational_modification", "[RK][RK][^RK]Y"),
    "disulfide_bond": ("structural", "C[^C]*C"),
    "nuclear_localization": ("functional", "[RK][RK][RK][RK]"),
    "signal_peptide": ("functional", f"[{_ANY}]{{10,30}}[{_ANY}]{{3,7}}[{_ANY}]{{3,7}}"),
    "transmembrane": ("structural", f"[{_ANY}]{{19,23}}"),
    "zinc_finger": ("functional", "C[^C]*C[^C]*C[^C]*C"),
    "leucine_zipper": ("functional", f"[{_ANY}]*L[{_ANY}]{{6}}L[{_ANY}]{{6}}L"),
    "helix_turn_helix": ("structural", f"[{_ANY}]{{20,30}}"),
    "beta_sheet": ("structural", f"[{_ANY}]{{5,15}}"),
    "proline_rich": ("compositional", "P[^P]*P[^P]*P"),
    "glycine_rich": ("compositional", "G[^G]*G[^G]*G"),
    "acidic_cluster": ("compositional", "[DE]{3,}"),
    "basic_cluster": ("compositional", "[RK]{3,}"),
    "hydrophobic_cluster": ("compositional", "[ACFILMPVWY]{5,}"),
    "polar_cluster": ("compositional", "[DEHKNQRST]{5,}"),
    "calcium_binding": ("binding", "[DE][DE][DE][DE]"),
    "atp_binding": ("binding", "[AG][AG][AG][AG]K[ST]"),
    "metal_binding": ("binding", "[CH][CH][CH][CH]"),
    "dna_binding": ("binding", "[RK][RK][RK][RK]"),
    "protein_binding": ("binding", "[DE][DE][DE][DE]"),
}

# Dipeptide classes; a pair of one polar and one other residue weighs -1, AA and CC weigh 1, other pairs of two
# small residues 0, all others 1.
DIPEPTIDE_POLAR = "DEHKNQR"
DIPEPTIDE_SMALL = "ACGPST"
DIPEPTIDE_WHOLE = ("AA", "CC")


def _dipeptide(a: str, b: str) -> float:
    if (a in DIPEPTIDE_POLAR) != (b in DIPEPTIDE_POLAR):
        return -1.0
    small = a in DIPEPTIDE_SMALL and b in DIPEPTIDE_SMALL
    return 0.0 if small and a + b not in DIPEPTIDE_WHOLE else 1.0


# Link target -> category, whether the id is appended, and base address.
DATABASES = {
    "uniprot": ("sequence_database", True, "https://www.uniprot.org/uniprot/"),
    "ncbi_protein": ("sequence_database", True, "https://www.ncbi.nlm.nih.gov/protein/"),
    "pdb": ("structure_database", True, "https://www.rcsb.org/structure/"),
    "alphafold": ("structure_database", True, "https://alphafold.ebi.ac.uk/entry/"),
    "pfam": ("domain_database", True, "https://pfam.xfam.org/protein/"),
    "prosite": ("domain_database", False, "https://prosite.expasy.org/scanprosite/"),
    "interpro": ("domain_database", True, "https://www.ebi.ac.uk/interpro/protein/"),
    "smart": ("domain_database", True, "https://smart.embl.de/smart/do_annotation.pl?DOMAIN="),
    "kegg": ("pathway_database", True, "https://www.genome.jp/dbget-bin/www_bget?"),
    "reactome": ("pathway_database", True, "https://reactome.org/content/detail/"),
    "string": ("interaction_database", True, "https://string-db.org/cgi/input.pl?sessionId="),
    "intact": ("interaction_database", True, "https://www.ebi.ac.uk/intact/interactions/"),
    "mint": ("interaction_database", True, "https://mint.bio.uniroma2.it/"),
    "go": ("annotation_database", True, "http://amigo.geneontology.org/amigo/term/"),
    "enzyme": ("enzyme_database", False, "https://enzyme.expasy.org/EC/"),
    "brenda": ("enzyme_database", False, "https://www.brenda-enzymes.org/enzyme.php?ecno="),
    "metacyc": ("pathway_database", False, "https://metacyc.org/META/NEW-IMAGE?type=REACTION&object="),
    "chebi": ("chemical_database", False, "https://www.ebi.ac.uk/chebi/searchId.do?chebiId="),
    "pubchem": ("chemical_database", False, "https://pubchem.ncbi.nlm.nih.gov/compound/"),
    "chembl": ("chemical_database", False, "https://www.ebi.ac.uk/chembl/compound_report_card/"),
    "drugbank": ("drug_database", False, "https://go.drugbank.com/drugs/"),
    "bindingdb": ("binding_database", False, "https://www.bindingdb.org/bind/chemsearch/marvin/MolStructure.jsp?monomerid="),
    "pdb_ligand": ("ligand_database", False, "https://www.rcsb.org/ligand/"),
    "proteomicsdb": ("proteomics_database", True, "https://www.proteomicsdb.org/proteomicsdb/#protein/proteinDetails/"),
    "peptideatlas": ("proteomics_database", True, "https://db.systemsbiology.net/sbeams/cgi/PeptideAtlas/GetProtein?protein_name="),
    "pride": ("proteomics_database", False, "https://www.ebi.ac.uk/pride/archive/projects/"),
    "massive": ("proteomics_database", False, "https://massive.ucsd.edu/ProteoSAFe/dataset.jsp?task="),
    "peptide_db": ("peptide_database", False, "https://www.peptides.be/"),
    "antibodypedia": ("antibody_database", False, "https://antibodypedia.com/gene/"),
    "imgt": ("immunology_database", False, "https://www.imgt.org/IMGT_GENE-DB/GENElect?query=7.14+"),
    "iedb": ("immunology_database", False, "https://www.iedb.org/result_v3.php?cookie_id="),
    "allergome": ("allergen_database", False, "https://www.allergome.org/script/dettaglio.php?id_molecule="),
    "allergenonline": ("allergen_database", False, "https://www.allergenonline.org/databasefasta.shtml"),
    "toxin_pred": ("toxin_database", False, "http://crdd.osdd.net/raghava/toxinpred/"),
    "venomkb": ("toxin_database", True, "https://venomkb.org/proteins/"),
    "t3db": ("toxin_database", False, "https://www.t3db.ca/toxins/"),
    "phobius": ("prediction_tool", False, "https://phobius.sbc.su.se/"),
    "wolfpsort": ("prediction_tool", False, "https://wolfpsort.hgc.jp/"),
    "psort": ("prediction_tool", False, "https://psort.hgc.jp/form.html"),
    "tmhmm": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?TMHMM-2.0"),
    "signalp": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?SignalP-5.0"),
    "targetp": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?TargetP-2.0"),
    "netphos": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetPhos-3.1"),
    "netnglyc": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetNGlyc-1.0"),
    "netoglyc": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetOGlyc-4.0"),
    "netcglyc": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetCGlyc-1.0"),
    "netacety": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetAcet-1.0"),
    "netmethyl": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMethyl-1.0"),
    "netub": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetUbi-1.0"),
    "netsumo": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetSUMO-1.0"),
    "netnit": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetNit-1.0"),
    "netglu": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetGlu-1.0"),
    "netmal": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMal-1.0"),
    "netsuc": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetSuc-1.0"),
    "netcarn": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetCarn-1.0"),
    "netmyr": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMyr-1.0"),
    "netpal": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetPal-1.0"),
    "netpre": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetPre-1.0"),
    "netgly": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetGly-1.0"),
    "netadp": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetADP-1.0"),
    "netchop": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetChop-3.1"),
    "netctl": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetCTL-1.2"),
    "netmhc": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHC-4.0"),
    "netmhcpan": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHCpan-4.1"),
    "netmhcii": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHCII-2.3"),
    "netmhciipan": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHCIIpan-4.0"),
    "netctlpan": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetCTLpan-1.1"),
    "netmhcstab": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHCstab-1.0"),
    "netmhcstabpan": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHCstabpan-1.0"),
    "netmhccons": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHCcons-1.1"),
    "netmhcconspan": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHCconsPan-1.1"),
    "netmhcconsstab": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHCconsStab-1.0"),
    "netmhcconsstabpan": ("prediction_tool", False, "https://services.healthtech.dtu.dk/service.php?NetMHCconsStabPan-1.0"),
}

AMINO_ACIDS = "".join(RESIDUES)
DIPEPTIDES = {a + b: _dipeptide(a, b) for a in sorted(RESIDUES) for b in sorted(RESIDUES)}
ALPHABET = "".join(sorted(RESIDUES))
MAX_LENGTH = 50_000
EXTINCTION = {"W": 5500.0, "Y": 1490.0, "C": 62.5}
N_TERMINUS, C_TERMINUS = 8.0, 3.1
