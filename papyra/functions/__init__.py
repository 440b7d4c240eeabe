"""papyra.functions"""
